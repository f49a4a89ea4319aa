"""A small documents table with the awkward cases."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _part string, size long, label string"


def awkward():
    long = " ".join(f"word{i % 997}" for i in range(30000))
    base = " ".join(f"alpha{i}" for i in range(60))
    texts = [(1, base), (2, base), (3, base.replace("alpha30", "beta")), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, long), (9, long), (10, "éàü ß 日本語 " * 20), (None, base), (11, "x" * 5000), (12, "12345 67890")]
    return [(i, t, "en" if k % 3 else None, "s" if k % 4 else None, None, "p", 1, "l") for k, (i, t) in enumerate(texts)]
