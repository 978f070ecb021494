"""Texts and paths that several test files of the training-data operators import."""

SF = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor sit amet " * 20_000
# NULLs, empty and blank texts, repeats, ties and a very long one.
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (4, "one"), (None, "one two three"),
    (5, "a b c a b c a b c"), (6, LONG), (7, "x\n\nx\nx y\n x\n"), (8, "É ß 日本 ẞ é"), (None, None),
]
