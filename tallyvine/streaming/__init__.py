"""The same operators over streams of new files."""
