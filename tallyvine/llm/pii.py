"""Personal data by patterns and a skip-chain conditional random field (operator 5).

Base mentions come from four patterns. Around them each text gets a field over its tokens: mentions are
observed; open are tokens that repeat a mention or a telling part of it (the local part of an address, the
digits of a number, with or without separators), and near misses of the patterns: a card number of the right length that fails its check, a telephone
number that runs into what follows, an address with parts out of range, an e-mail address with "at" and "dot" spelled out.
Also open are masked card numbers, which are similar to a mention that ends in the same four digits.
Consecutive tokens of the field share a chain potential, and a side of a near miss (before it, after it) without any mention speaks against it;
consecutive occurrences of the same or a similar form (one half of it and the length agree), however distant, share a skip potential (consecutive ones only, so a
form that occurs n times has n - 1 edges). Loopy message passing, repeated until it settles, then gives each open token the label that is consistent
across the text.

The potentials are trained piecewise, over all documents. Repeats: how often the forms of mentions recur in texts with the mention, and, as what
chance brings, in texts without it. Chain: how much oftener than any word a mention has another one before or after it. Near misses: the refusal of the
pattern stands as their label where no mention is in the text; elsewhere the share that their company supports (its estimate, between the rates of any word
and of mentions, less one standard error) counts as mentions. So the same number can be a mention beside others and none by itself.

Defined results: a null text is the empty string; rows with null or repeated ids each get the
mentions of their text; an empty table gives an empty result; extra columns are ignored.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from ast import literal_eval
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, whole_text, written

KINDS = ("email", "ip", "card", "phone")
#: Message passing ends when no message moves by more than SETTLED; every SLOWER sweeps the steps are halved, so it ends in every text.
SETTLED, SLOWER = 1e-4, 100
#: Standard errors (the one-standard-error rule) that the share of mentions among near misses must clear.
ERRORS = 1.0
#: A telling part has so many characters, or so many digits, at least.
LEAST_NAME, LEAST_DIGITS = 5, 7

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\W_]+(?:[.@_+-][^\W_]+)*")
DIGIT = "0123456789"
BEFORE_DOT = [f"{d}." for d in DIGIT]
SIGNS = DIGIT + ".@_+-"
DIGITS = re.compile(r"[0-9]+")
PHONE_HEAD = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9])")
MASKED = re.compile(r"(?:[0-9]{4}[\x20-]?)?(?:[*xX\u2022]{2,4}[\x20-]?){2,4}[0-9]{4}(?![0-9])")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]+)+", re.I)

Span = tuple[int, int, int]  # kind, start, end


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Linear: an @ ends the run of characters before it, so each run is looked at once."""
    end = 0
    for m in DOMAIN.finditer(text):
        run = text[max(end, text.rfind("@", 0, m.start()) + 1) : m.start()][::-1]
        if n := LOCAL.match(run).end():
            end = m.end()
            yield m.start() - n, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def has_any(text: str, parts: Iterable[str]) -> bool:
    """A plain search for each part: much faster than a pattern on texts that have none."""
    return any(x in text for x in parts)


def dotted_quads(text: str) -> list[re.Match]:
    return list(IP.finditer(text)) if has_any(text, BEFORE_DOT) else []


def base_mentions(text: str) -> list[Span]:
    """By kind, then start. Matches are leftmost and do not overlap within a kind; failing ones are dropped."""
    found: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if has_any(text, DIGIT):
        found += [(1, *m.span()) for m in dotted_quads(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() and 16 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
    return found


def near_misses(text: str, mentions: list[Span]) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, why) of what almost fits a pattern, stands free and overlaps no mention, in text order."""
    taken = sorted((a, b) for _, a, b in mentions)
    found = [(0, *m.span(), "spelled") for m in SPELLED.finditer(text)] if has_any(text, "[({") and "at" in text.lower() else []
    if has_any(text, DIGIT):
        found += [(1, *m.span(), "range") for m in dotted_quads(text) if all(len(p) <= 3 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            n = sum(map(len, DIGITS.findall(m[0])))
            if 13 <= n <= 19:
                found.append((2, *m.span(), "short" if n < 16 else "check"))
        if "+" in text:
            for m in PHONE.finditer(text):
                i = bisect_left(taken, (m.start(), 0))
                head = PHONE_HEAD.match(text, m.start(), min(m.end(), taken[i][0]) if i < len(taken) else m.end())
                if head and 8 <= sum(map(len, DIGITS.findall(head[0]))) <= 15:
                    found.append((3, *head.span(), "overrun"))
        if has_any(text, ("**", "xx", "XX", "\u2022")):
            found += [(2, *m.span(), "masked") for m in MASKED.finditer(text) if 13 <= len(re.sub(r"[\x20-]", "", m[0])) <= 19]
    out = []
    for kind, a, b, why in sorted(found, key=lambda x: (x[1], -x[2])):
        if text[max(0, a - 1) : a].isalnum() or text[b : b + 1].isalnum():
            continue
        i = bisect_left(taken, (a, b))
        if not (i < len(taken) and taken[i][0] < b or i and taken[i - 1][1] > a):
            taken.insert(i, (a, b))
            out.append((kind, a, b, why))
    return out


def forms(kind: int, mention: str) -> list[str]:
    """The forms under which a mention may recur: itself, and its telling part."""
    lower = mention.lower()
    if kind == 0:
        local = lower.split("@")[0]
        return [lower] + [local] * (len(local) >= LEAST_NAME and any(c in local for c in "._-+0123456789"))
    digits = "".join(DIGITS.findall(lower))
    return [lower] + [digits] * (kind != 1 and len(digits) >= LEAST_DIGITS)


def shape(token: str) -> str:
    """What the node potential sees of a token."""
    digits = sum(c.isdigit() for c in token)
    return ("@" if "@" in token else "") + ("n" if digits == len(token) else "m" if digits else "w") + ("." if "." in token else "") + str(min(len(token) // 4, 5))


class Potentials:
    """Log potentials: node[kind, shape of the form] and miss[kind, why] of being a mention, chain and skip for two tokens that agree rather than not, end for each side of a near miss that has no mention."""

    def __init__(self, counts: Counter | None = None):
        c = counts or Counter()
        odds = lambda yes, no: math.log((c[yes] + 1) / (c[no] + 1))
        self.node = {k[1:]: odds(k, ("out", *k[1:])) for k in [k for k in c if k[0] == "in"]}
        self.prior = min(-1.0, odds("mention", "token"))
        self.skip = max(0.5, min(4.0, odds("skip agrees", "skip differs")))
        rate = lambda *key: (c[*key, True] + 1) / (c[*key, True] + c[*key, False] + 2)
        mention, word = rate("beside", "mention"), rate("beside", "word")
        self.chain = max(0.0, min(4.0, math.log(mention / word)))
        self.end = max(-4.0, min(0.0, math.log((1 - mention) / (1 - word))))
        self.miss = {}
        for kind, why in {k[2:4] for k in c if k[:2] == ("company", "miss")}:
            beside, alone = c["company", "miss", kind, why, True], c["company", "miss", kind, why, False]
            usual = rate("company", "mention")  # one more near miss like a mention, so that a rate of few isn't drawn to one half
            yes = beside * supported_share((beside + usual) / (beside + alone + 1), beside + alone, usual, rate("company", "word"))
            self.miss[kind, why] = math.log((yes + 1) / (beside + alone - yes + 1))


def supported_share(rate: float, n: int, mention: float, word: float) -> float:
    """Share of mentions among n near misses that keep company at this rate, between the rates of any word and of mentions: the estimate less ERRORS standard errors."""
    if mention <= word:
        return 0.0
    error = math.sqrt(rate * (1 - rate) / max(n, 1))
    return max(0.0, min(1.0, (rate - word) / (mention - word)) - ERRORS * error / (mention - word))


def _open_tokens(text: str, mentions: list[Span]) -> tuple[list[Span], dict[str, list[int]]]:
    """Nodes in text order as (kind or -1, start, end), and the nodes of each form."""
    keys: dict[str, int] = {}
    for kind, a, b in mentions:
        for form in forms(kind, text[a:b]):
            keys.setdefault(form, kind)
    covered = sorted((a, b) for _, a, b in mentions)
    nodes: list[tuple[int, int, int, str | None]] = [(k, a, b, f) for k, a, b in mentions for f in forms(k, text[a:b])]
    at, reach = 0, -1
    for m in TOKEN.finditer(text):
        token = m[0].lower()
        key = token if token in keys else d if (d := "".join(DIGITS.findall(token))) in keys and len(d) >= LEAST_DIGITS else None
        if key is None:
            continue
        while at < len(covered) and covered[at][0] < m.end():
            reach, at = max(reach, covered[at][1]), at + 1
        if reach <= m.start():
            nodes.append((-1, m.start(), m.end(), key))
    nodes.sort(key=lambda x: x[1:3])
    by_form: dict[str, list[int]] = {}
    plain: list[Span] = []
    index: dict[tuple[int, int, int], int] = {}
    for k, a, b, f in nodes:
        if (k, a, b) not in index:
            index[k, a, b] = len(plain)
            plain.append((k, a, b))
        by_form.setdefault(f, []).append(index[k, a, b])
    return plain, by_form


def beliefs(field: list[float], edges: dict[tuple[int, int], float]) -> list[float]:
    """Log-odds of each node of a pairwise field with two states, by loopy message passing; exact on trees.

    A sweep goes through the nodes forth and back, so what one end of a chain says reaches the other in one sweep."""
    around: list[list[tuple[int, float]]] = [[] for _ in field]
    for (i, j), w in edges.items():
        around[i].append((j, math.tanh(w / 2) * (1 - 1e-12)))
        around[j].append((i, math.tanh(w / 2) * (1 - 1e-12)))
    message = {(i, j): 0.0 for a, b in edges for i, j in ((a, b), (b, a))}
    linked = [i for i, links in enumerate(around) if links]
    moved, sweep = math.inf, 0
    while linked and moved > SETTLED:
        moved, step = 0.0, 0.5 ** (sweep // SLOWER)
        for i in (*linked, *reversed(linked)):
            into = field[i] + sum(message[j, i] for j, _ in around[i])
            for j, t in around[i]:
                x = max(-30.0, min(30.0, into - message[j, i]))
                change = step * (2 * math.atanh(t * math.tanh(x / 2)) - message[i, j])
                message[i, j] += change
                moved = max(moved, abs(change))
        sweep += 1
    return [field[i] + sum(message[j, i] for j, _ in around[i]) for i in range(len(field))]


def consistent_mentions(text: str, mentions: list[Span], potentials: Potentials) -> list[Span]:
    """Mentions that the field adds: open tokens whose belief in a kind exceeds one half."""
    misses = near_misses(text, mentions)
    if not mentions and not misses:
        return []
    nodes, by_form = _open_tokens(text, mentions)
    repeats = len(nodes)
    misses = [x for x in misses if not any(k < 0 and a < x[2] and x[1] < b for k, a, b in nodes)]
    if not misses and all(k >= 0 for k, _, _ in nodes):
        return []
    kinds_of: dict[int, int] = {}
    form_of = {i: form for form, members in by_form.items() for i in members}
    edges: dict[tuple[int, int], float] = {}
    for members in by_form.values():
        kind = next((nodes[i][0] for i in members if nodes[i][0] >= 0), -1)
        for i in members:
            kinds_of.setdefault(i, kind)
        for i, j in zip(members, members[1:], strict=False):
            if i != j:
                edges[i, j] = edges.get((i, j), 0.0) + potentials.skip
    field = [30.0 if k >= 0 else potentials.node.get((kinds_of.get(i, -1), shape(form_of[i])), potentials.prior) for i, (k, _, _) in enumerate(nodes)]
    nodes = nodes + [(-1, a, b) for _, a, b, _ in misses]
    for i, (kind, _, _, why) in enumerate(misses, repeats):
        kinds_of[i] = kind
        field.append(potentials.miss.get((kind, why), potentials.prior))
    order = sorted(range(len(nodes)), key=lambda i: nodes[i][1:])
    similar: dict[tuple | str, int] = {}
    masked = {i for i, x in enumerate(misses, repeats) if x[3] == "masked"}
    for i in order:
        form = text[nodes[i][1] : nodes[i][2]].lower()
        half = len(form) // 2
        halves = ((kinds_of.get(i), len(form), 0, form[:half]), (kinds_of.get(i), len(form), 1, form[half:]))
        for key in halves if i not in masked else ():  # masks are no common form
            j = similar.get(key)
            if j is not None and (i >= repeats or j >= repeats):
                edges[min(i, j), max(i, j)] = potentials.skip
            similar[key] = i
        if kinds_of.get(i) == 2:
            j = similar.get(form[-4:])
            if j is not None and (i in masked or j in masked):
                edges[min(i, j), max(i, j)] = potentials.skip
            similar[form[-4:]] = i
    first, last = min((a for _, a, _ in mentions), default=len(text)), max((b for *_, b in mentions), default=0)
    for i, (_, a, b, _) in enumerate(misses, repeats):
        field[i] += potentials.end * ((first > a) + (last < b))
    for i, j in zip(order, order[1:], strict=False):
        if i >= repeats or j >= repeats or nodes[j][1] - nodes[i][2] <= 1 and kinds_of.get(i) == kinds_of.get(j):
            edge = (min(i, j), max(i, j))
            edges[edge] = edges.get(edge, 0.0) + potentials.chain
    belief = beliefs(field, edges)
    return [(kinds_of[i], a, b) for i, (k, a, b) in enumerate(nodes) if k < 0 and belief[i] > 0 and kinds_of.get(i, -1) >= 0]


def _factors(text: str, c: Counter, forms_of: dict[str, list]) -> None:
    """Add one text's factors. c: how often mentions and any words have a mention before and after them ("beside"), how often they and near misses stand in a text with
    (other) mentions ("company"), pairs of two mentions, or by their open token ("skip"). forms_of: per form [kind, texts with its mention, open tokens there, tokens in texts without it]."""
    mentions = base_mentions(text)
    said = {text[a:b] for _, a, b in mentions}
    words = text.count(" ") + 1
    several = len(said) > 1
    c["company", "mention", several] += len(mentions)
    c["company", "word", bool(said)] += words
    beside = 0
    if mentions:
        beside = text.count(" ", min(a for _, a, _ in mentions)) + text.count(" ", 0, max(b for *_, b in mentions))
        c["beside", "mention", True] += 2 * (len(mentions) - 1) if several else 0
        c["beside", "mention", False] += 2 if several else 2 * len(mentions)
    c["beside", "word", True] += beside
    c["beside", "word", False] += 2 * words - beside
    for kind, _, _, why in near_misses(text, mentions):
        c["company", "miss", kind, why, bool(said)] += 1
    own = {f: k for k, a, b in reversed(mentions) for f in forms(k, text[a:b])}
    for form, kind in own.items():
        row = forms_of.setdefault(form, [None, 0, 0, 0])
        row[0] = kind if row[0] is None else min(kind, row[0])
        row[1] += 1
    signed = text.replace(". ", " ").replace(".\n", "\n").rstrip(".")  # a form has a digit or a sign in it, which isn't the end of a sentence
    for token in TOKEN.findall(" ".join([w for w in signed.lower().split() if not w.isalpha()])) if has_any(signed, SIGNS) else ():
        if not token.isalpha():
            digits = "".join(DIGITS.findall(token))
            for form in {token, digits} if len(digits) >= LEAST_DIGITS else {token}:
                if form not in own:
                    forms_of.setdefault(form, [None, 0, 0, 0])[3] += 1
    if not mentions:
        return
    nodes, by_form = _open_tokens(text, mentions)
    form_of = {i: form for form, members in by_form.items() for i in members}
    for form, members in by_form.items():
        forms_of[form][2] += sum(nodes[i][0] < 0 for i in members)
        for i, j in zip(members, members[1:], strict=False):
            ends = [form_of[x] for x in (i, j) if nodes[x][0] < 0]
            if i == j:
                continue
            if ends:
                c["skip", len(ends), own[ends[-1]], shape(ends[-1])] += 1
            else:
                c["skip", "agrees" if nodes[i][0] == nodes[j][0] else "differs"] += 1


def _factor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each form of a batch, and one (without a form) for each other factor."""
    for batch in batches:
        c: Counter = Counter()
        forms_of: dict[str, list] = {}
        for text in batch.text:
            _factors(text, c, forms_of)
        rows = [(f, shape(f), *x, None, 0) for f, x in forms_of.items()] + [(None, None, None, 0, 0, 0, repr(k), n) for k, n in c.items() if n]
        out = pd.DataFrame(rows, columns=["form", "shape", "kind", "with", "open", "chance", "key", "n"])
        yield out.astype({"kind": "Int32"})


def expected_counts(c: Counter, n_docs: int, n_forms: Counter) -> Counter:
    """Of the open tokens of each kind and shape, as many as chance brings to texts without the mention are none."""
    out: Counter = Counter()
    true: dict[tuple[int, str], float] = {}
    for key, n in c.items():
        if key[0] == "open" and n:
            at = key[1:]
            without = max(1, n_forms[at] * n_docs - c["with", *at])
            chance = min(n, c["with", *at] * c["chance", *at] / without)
            true[at] = 1 - chance / n
            for name, x in ((("in", *at), n - chance), (("out", *at), chance), ("mention", n - chance), ("token", chance)):
                out[name] += x
    for key, n in c.items():
        if key[0] in ("company", "beside"):
            out[key] = n
        if key[0] == "skip":
            p = {"agrees": 1.0, "differs": 0.0}.get(key[1])
            if p is None:
                p = true.get(key[2:], 0.0)
                p = p if key[1] == 1 else p * p + (1 - p) ** 2
            out["skip agrees"] += n * p
            out["skip differs"] += n * (1 - p)
    return out


def train(docs: DataFrame) -> Potentials:
    """Potentials from all texts. Forms are counted where they meet, by Spark; what comes to the driver is bounded by kinds and shapes."""
    schema = "form string, shape string, kind int, with long, open long, chance long, key string, n long"
    rows = written(docs.select(whole_text().alias("text")).mapInPandas(_factor_rows, schema), "pii-factors")
    sums = [F.sum(x).alias(x) for x in ("with", "open", "chance")]
    by_form = rows.where("form is not null").groupBy(F.xxhash64("form").alias("form"), "shape").agg(F.min("kind").alias("kind"), *sums)
    by_shape = by_form.where("kind is not null").groupBy("kind", "shape").agg(*sums, F.count(F.lit(1)).alias("forms"))
    c, n_forms = Counter(), Counter()
    for r in by_shape.collect():
        n_forms[r.kind, r["shape"]] = r.forms
        c.update({(x, r.kind, r["shape"]): r[x] for x in ("with", "open", "chance")})
    for r in rows.where("form is null").groupBy("key").agg(F.sum("n").alias("n")).collect():
        c[literal_eval(r.key)] = r.n
    return Potentials(expected_counts(c, docs.count(), n_forms))


def find_mentions(docs: DataFrame, potentials: Potentials) -> DataFrame:
    """doc_id, n_<kind> of the base mentions, base_sha256 and spans of every row."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            rows = []
            for text in batch.text:
                base = base_mentions(text)
                every = sorted({*base, *consistent_mentions(text, base, potentials)})
                kinds = Counter(k for k, _, _ in base)
                rows.append((*(kinds[k] for k in range(len(KINDS))), hashlib.sha256(said(base).encode()).hexdigest(), said(every)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out.insert(0, "doc_id", batch.doc_id.to_numpy())
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInPandas(found, f"doc_id long, {counts}, base_sha256 string, spans string")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return find_mentions(docs, train(docs))
