"""Rows that every operator must take, and how results are compared."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, content string, kept string, score string, hot string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew some ale "


def edge_rows():
    """Nulls everywhere, empty, long, tied and repeated rows, and clashing columns."""
    long = " ".join(f"word{k % 997} of{k % 31}" for k in range(40_000))
    shared = "a passage that many of these documents share, word for word; " * 8
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "Plain text."), (5, "Plain  text."), (6, "Plain text."), (6, "Plain text."),
        (None, "Plain text."), (None, None), (7, long), (8, long + " end"), (9, "x" + shared + "y"), (10, "other " + shared),
        (11, shared), (12, PROSE * 12), (13, PROSE * 12 + "extra"), (14, PROSE.upper() * 12), (15, "Größe ÄÖ ſ ǅ İ 日本 é   ok"),
        (16, "a" * 1500), (17, "<|endoftext|> is's 12 3"), (18, "one"), (-5, "one"), (9, "x" + shared + "y"),
    ]
    return [(d, t, None, None if k % 4 == 0 else f"s{k % 3}", None, k, "c", None, "s", "h") for k, (d, t) in enumerate(texts)]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)
