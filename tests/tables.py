"""The tables that tests read, and how results are compared."""

SF = "/root/testdata/sf0.001"


def rows(table):
    """Rows of an Arrow table as sorted text, columns by name, numbers rounded."""
    table = table.select(sorted(table.column_names))

    def text(x):
        return "\0" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(text, r)) for r in zip(*[c.to_pylist() for c in table.columns], strict=True))
