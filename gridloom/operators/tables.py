"""Results as text and HTML tables, and as a report of one run."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame


def _said(value: object, digits: int) -> str:
    if value is None:
        return "-"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def _rows(df: DataFrame, most: int, digits: int) -> tuple[list[list[str]], bool]:
    """At most ``most`` rows as text, and whether there are more."""
    rows = df.limit(most + 1).collect()
    return [[_said(v, digits) for v in r] for r in rows[:most]], len(rows) > most


def text_table(df: DataFrame, title: str = "", most: int = 1000, digits: int = 3) -> str:
    """Columns as wide as their longest value, numbers to the right. A report for reading: of larger results the first ``most`` rows, and a line that says so."""
    rows, more = _rows(df, most, digits)
    widths = [max(map(len, column)) for column in zip(df.columns, *rows)]
    right = [kind not in ("string", "boolean") for _, kind in df.dtypes]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, widths, right)).rstrip()
    out = [title] * bool(title) + [line(df.columns), "  ".join("-" * w for w in widths), *map(line, rows)]
    return "\n".join(out + [f"({most} rows of more)"] * more)


def html_table(df: DataFrame, title: str = "", best: str | None = None, most: int = 1000, digits: int = 3) -> str:
    """A table element; the row with the highest value in column ``best`` is marked."""
    rows, more = _rows(df, most, digits)
    at = df.columns.index(best) if best else -1
    number = lambda r: float(r[at]) if r[at] != "-" else float("-inf")
    top = max(range(len(rows)), key=lambda i: number(rows[i])) if best and rows else -1
    cells = lambda tag, values: "".join(f"<{tag}>{escape(v)}</{tag}>" for v in values)
    body = "\n".join(f"<tr{' class="best"' if i == top else ''}>{cells('td', r)}</tr>" for i, r in enumerate(rows))
    caption = f"<caption>{escape(title)}</caption>\n" if title else ""
    rest = f"\n<tfoot><tr><td colspan=\"{len(df.columns)}\">the first {most} rows</td></tr></tfoot>" if more else ""
    return f"<table>\n{caption}<thead><tr>{cells('th', df.columns)}</tr></thead>\n<tbody>\n{body}\n</tbody>{rest}\n</table>"


def html_page(tables: list[str], title: str) -> str:
    """A page of tables."""
    style = "body{font-family:sans-serif}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #bbb;padding:.2em .6em}.best{background:#dfd}"
    return f"<!doctype html>\n<html><head><meta charset=\"utf-8\"><title>{escape(title)}</title><style>{style}</style></head>\n<body>\n<h1>{escape(title)}</h1>\n" + "\n".join(tables) + "\n</body></html>\n"


def parameters(values: dict[str, object]) -> str:
    """The set parameters of a run, one a line."""
    shown = {k: v for k, v in values.items() if v not in (None, "", 0)}
    wide = max(map(len, shown), default=0)
    return "\n".join(f"{k.replace('_', ' ').ljust(wide)}  {v}" for k, v in shown.items())


def report(line: dict[str, object], times: list[float], colour: bool = False) -> str:
    """What a run was, its rounds' times five a line, and whether its checksums agree."""
    paint = lambda text, code: f"\033[{code}m{text}\033[0m" if colour else text
    same = line["rounds_had_same_checksums"] in (True, "true")
    verdict = paint("the same in every round", 32) if same else paint("not the same in every round", 31)
    groups = [times[i : i + 5] for i in range(0, len(times), 5)]
    return "\n".join(
        [
            paint(f"{line['automaton']}, {line['x_size']} x {line['y_size']} cells, {line['steps']} steps", 1),
            f"mean {line['average_time_ms']:.3f} ms, deviation {line['std_time_ms']:.3f} ms, {line['average_time_per_cell_ps']:.3f} ps a cell and step",
            *("  " + "  ".join(f"{t:10.3f}" for t in g) for g in groups),
            f"checksum {line['checksum']}, {verdict}",
        ]
    )
