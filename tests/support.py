"""Helpers that several test files import."""


def rows(df, *columns):
    """Sorted tuples of the given columns (default: all)."""
    names = columns or df.columns
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
