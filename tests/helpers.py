"""Small functions shared by tests of every folder."""


def rows(df, *order):
    """Collected rows as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
