"""Small tables for the tests of the corpus operators."""

SF_DIR = "/root/testdata/sf0.001"
# Nulls, empty texts, repeats of a row and of an id, and a text of many words.
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
    (2, None, "en", "a", 2),
    (3, "", None, None, None),
    (4, "The quick brown fox jumps over the lazy dog again and again", "en", "b", 4),
    (4, "The quick brown fox jumps over the lazy dog again and again", "en", "b", 4),
    (4, "another text under the same id", "en", "b", 5),
    (None, "a text without an id", None, "a", 6),
    (None, None, None, None, None),
    (7, " \t\n ", "de", "b", 7),
    (8, LONG, "en", "a", 8),
    (9, "12345 !!! 67", "de", "a", 9),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use for working columns or results.
CLASHES = ("_row _key _hash _nth _number row_hash fp root label position epoch first_position "
           "n_words n_hit items held_out spans _hit _text host path rule _fit target taken size").split()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
