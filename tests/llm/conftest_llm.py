"""Rows that every operator must take."""

LONG = "lorem ipsum dolor " * 20_000
#: Nulls, empty texts, repeated rows, ties, other scripts and a very long text.
ODD = [(1, None), (2, ""), (3, "One two three four"), (3, "One two three four"), (3, "another text of the same id"), (None, "one TWO three four"), (None, None), (4, "é ß 日本 \t\n  x"), (5, LONG), (6, " "), (7, "o")]
