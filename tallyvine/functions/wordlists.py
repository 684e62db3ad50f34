"""Labels, patterns and word lists that decide results; they must stay as they are."""

# Colours in the order in which a category is searched for them.
COLOR_LABELS = [("red", "красное"), ("white", "белое"), ("rose", "розовое"), ("orange", "оранжевое")]

# Sparkling wines by title, and by the opening of the description.
SPARKLING_TITLE = r"брют|bryut|brut|игрист|igrist|pet-?nat|петнат|пет-нат|шампанск|frizzante|фризанте"
SPARKLING_OPENING = r"игрист|(?<![\p{L}\p{N}_])брют|шампанск|пет-?нат|петнат"
OPENING_LENGTH = 250

# Sweetness by title (first match wins), then by a phrase of the description.
EDGE_BEFORE, EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
SWEETNESS_TITLE = [
    (rf"полусух|polusuh|{EDGE_BEFORE}p suh{EDGE_AFTER}", "полусухое"),
    (rf"полуслад|polusl|{EDGE_BEFORE}p sl{EDGE_AFTER}", "полусладкое"),
    (rf"{EDGE_BEFORE}(сладкое|sladkoe){EDGE_AFTER}", "сладкое"),
    (rf"{EDGE_BEFORE}(сухое|suhoe|suh){EDGE_AFTER}", "сухое"),
]
SWEETNESS_PHRASE = rf"{EDGE_BEFORE}(полусухое|полусладкое|сухое|сладкое)\s+(?:белое|красное|розовое|вино)"
DRY = "сухое"
SWEETNESS_WANTED = {"dry": ["сухое"], "semi": ["полусухое", "полусладкое"], "sweet": ["полусладкое", "сладкое"]}

# Sweetness as it is stated to a model; a part of a word is enough.
STATED_SWEETNESS = [
    ("полусух", "полусухое"), ("polusuh", "полусухое"), ("p_suh", "полусухое"), ("полуслад", "полусладкое"),
    ("polusl", "полусладкое"), ("p_sl", "полусладкое"), ("экстра брют", "экстра брют"), ("ekstra-bryut", "экстра брют"),
    ("ekstra_bryut", "экстра брют"), ("брют", "брют"), ("bryut", "брют"), ("сладк", "сладкое"), ("сух", "сухое"), ("suh", "сухое"),
]
NOT_STATED = "не указана"
STATED_LENGTH = 400

# Styles for pairing, by title and then by category, in this order.
STYLE_TITLE = [
    ("off_dry", ["полуслад"]), ("sweet", ["сладкое", "sladkoe"]),
    ("sparkling", ["брют", "bryut", "brut", "игрист", "pet-nat", "петнат"]),
]
STYLE_CATEGORY = [("red", "красн"), ("rose", "розов"), ("orange", "оранж")]
DEFAULT_STYLE = "white"

# Dishes, and what goes with each style, best first.
DISHES = {
    "fish": "Рыба", "seafood": "Морепродукты", "poultry": "Птица", "red_meat": "Красное мясо",
    "vegetables": "Овощные блюда", "cheese": "Сыр", "dessert": "Десерт", "spicy": "Острые блюда",
}
STYLE_LABELS = {
    "white": "Белое вино", "red": "Красное вино", "rose": "Розовое вино", "orange": "Оранжевое вино",
    "sparkling": "Игристое вино", "off_dry": "Полусладкое вино", "sweet": "Сладкое вино",
}
PAIRINGS = [
    ("white", 1, "fish", "Свежий профиль белого вина обычно подходит к нежному вкусу рыбы."),
    ("white", 2, "seafood", "Свежесть вина не перекрывает тонкий вкус морепродуктов."),
    ("white", 3, "poultry", "Лёгкая структура вина подходит к блюдам из птицы без тяжёлого соуса."),
    ("red", 1, "red_meat", "Более плотный профиль красного вина подходит к насыщенному мясному блюду."),
    ("red", 2, "cheese", "Выразительный сыр может поддержать насыщенность красного вина."),
    ("red", 3, "poultry", "Птица с насыщенным соусом может сочетаться с красным вином."),
    ("rose", 1, "poultry", "Лёгкий ягодный профиль подходит к птице без тяжёлого соуса."),
    ("rose", 2, "vegetables", "Розовое вино может поддержать вкус овощей на гриле."),
    ("rose", 3, "cheese", "Не слишком выдержанный сыр сохраняет баланс с лёгким розовым вином."),
    ("orange", 1, "cheese", "Насыщенный аромат оранжевого вина подходит к выразительному сыру."),
    ("orange", 2, "poultry", "Структура вина может выдержать птицу с пряностями."),
    ("orange", 3, "vegetables", "Запечённые овощи поддерживают насыщенный профиль вина."),
    ("sparkling", 1, "seafood", "Пузырьки освежают вкус после морепродуктов."),
    ("sparkling", 2, "fish", "Игристое вино не перекрывает нежный вкус рыбы."),
    ("sparkling", 3, "cheese", "Свежесть игристого вина помогает уравновесить солоноватый сыр."),
    ("off_dry", 1, "spicy", "Умеренная сладость может смягчить остроту блюда."),
    ("off_dry", 2, "cheese", "Солоноватый сыр может уравновесить сладость вина."),
    ("off_dry", 3, "dessert", "К умеренно сладкому десерту можно попробовать полусладкое вино."),
    ("sweet", 1, "dessert", "Сладкое вино обычно подают к десерту сопоставимой сладости."),
    ("sweet", 2, "cheese", "Контраст сладкого вина и солоноватого сыра может быть удачным."),
    ("sweet", 3, "spicy", "Сладость вина может смягчить остроту блюда."),
]
UNSURE_REASON = "По данным карточки нельзя уверенно оценить это сочетание."
ACIDITY_STEM, ACIDITY_REASON = "кислотн", " В описании отмечена кислотность, которая освежает вкус."
TANNIN_STEM, TANNIN_REASON = "танин", " В описании отмечены танины, которые поддерживают мясное блюдо."
BETTER_DISH = " Для более предсказуемого сочетания рассмотрите вариант: "
FITS = ["хорошо подходит", "можно попробовать", "сочетание зависит от блюда"]
PAIRING_BASIS = "Подсказка основана на категории, названии и отдельных сведениях из описания вина; вкусовые предпочтения могут отличаться."

# Stems by which a description mentions a dish.
DISH_STEMS = {
    "fish": ["рыб"], "seafood": ["морепродукт", "устриц", "мидии", "креветк"], "poultry": ["птиц", "куриц", "утк", "индейк"],
    "red_meat": ["мяс", "стейк", "говяд", "баранин", "дичь", "шашлык"], "vegetables": ["овощ", "салат"], "cheese": ["сыр"],
    "dessert": ["десерт", "фрукт", "выпечк", "шоколад"], "spicy": ["остр", "азиатск", "пряны"],
}
TYPICAL = {
    "fish": "белое сухое или игристое брют", "seafood": "белое сухое или игристое брют", "poultry": "белое или розовое",
    "red_meat": "сухое красное", "vegetables": "розовое или белое", "cheese": "красное, оранжевое или сладкое",
    "dessert": "сладкое или полусладкое", "spicy": "полусладкое белое или розовое",
}
COLOR_PHRASES = {
    "red": "среди красных", "white": "среди белых", "rose": "среди розовых", "orange": "среди оранжевых", "sparkling": "среди игристых",
}

# Reasons and notes of recommendations.
SAME_STYLE, SAME_GRAPE, ALSO, SIMILAR_NOTES = "тот же стиль вина", "тот же сорт: ", "тоже ", "похожие ноты: "
TEXT_ADVISES, FITS_ANSWERS, ANY_COLOR = "описание советует: ", "подходит под ваши ответы", "в каталоге"
NO_SUCH_SWEETNESS = "Вин с такой сладостью {color} нет — показываю ближайшие без учёта сладости."
NO_SUCH_DISH = "Прямых рекомендаций к блюду «{dish}» среди таких вин нет; к нему обычно берут {typical}. Вот ближайшие по стилю."

# Words of descriptions that say nothing about taste, and the endings of adjectives.
TASTE_WORD = "[а-яё]{4,}"
STOP_WORDS = """вино вина вином винограда виноград винодельни винодельня аромат аромате ароматы ароматом вкус вкусе вкуса вкусом
послевкусие послевкусии нотами ноты нотки нотками тона тонами оттенки оттенками оттенком цвет цвета цвете яркий яркие яркое хорошо
очень также может более которые которое который этого этот этом этой сорта сорт сортов года годом лет подходит подойдет подойдёт
отлично идеально сочетается сочетания сочетание блюдам блюдами блюда блюд выдержка выдержки выдержано выдерживается бочках бочке
дубовых дубе нержавеющей стали ферментация урожая урожай производства собранного собранный ручной ручного свежий свежие свежее
свежая""".split()
ADJECTIVE = "(ые|ых|ый|ий|ая|яя|ое|ее|ой|ую|юю|ым|им|ими|ыми|ого|его|ому|ему)$"

# Words of labels that every bottle carries; years are the only numbers that tell.
LABEL_STOP_WORDS = [
    "vino", "vinodelnia", "semeinaia", "semeinaiavinodelnia", "sukhoe", "krasnoe", "beloe", "rozovoe", "rossiiskoe", "rossiia",
    "godurozhaia", "kuban", "anapa", "vynograd", "vynograda", "sukhiekrasnoe", "sukhoekrasnoe", "wine", "winery",
]
YEAR = "(19|20)[0-9]{2}"

# Cyrillic letters in Latin ones.
LATIN_PAIRS = ("абвгдезийклмнопрстуфыэ", "abvgdeziiklmnoprstufye")
LATIN_LONG = {"ё": "io", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "iu", "я": "ia"}

# Weights and limits of the search and its answers.
SEARCH_WIDTH, VERIFIED_WIDTH, KEPT_WIDTH, SHOWN_WIDTH = 20, 7, 6, 5
VERIFIER_WEIGHT, LEXICAL_WEIGHT = 0.02, 0.03
UNCLEAR_MARGIN, TEMPERATURE, CONFIDENT = 0.015, 0.02, 0.7
MAX_UPLOAD = 16 * 1024 * 1024

# Parts of an image (left, top, right, bottom) that are looked at, and the side of a view.
REFERENCE_TRIM_DIFFERENCE, REFERENCE_TRIM_SHARE, VIEW_SIDE = 18, 0.08, 384
REFERENCE_VIEWS = [(0.0, 0.0, 1.0, 1.0), (0.06, 0.28, 0.94, 0.84), (0.10, 0.35, 0.90, 0.78), (0.0, 0.20, 1.0, 0.97)]
QUERY_VIEWS = [(0.0, 0.0, 1.0, 1.0), (0.22, 0.16, 0.78, 0.88), (0.15, 0.10, 0.85, 0.90)]
