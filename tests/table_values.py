"""Small helpers that several test modules use."""


def column(df, name):
    """Values of a column in the order of the ``k`` column."""
    return [r[name] for r in sorted(df.collect(), key=lambda r: r["k"])]
