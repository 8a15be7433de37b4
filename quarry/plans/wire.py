"""What goes over the wire: flat 1-based ranges, values that all matches share at the top, nothing that is empty."""

from __future__ import annotations

import json


def compact(value: dict) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def size_of(value: dict) -> int:
    return len(compact(value).encode())


def wire_range(row: dict) -> list[int]:
    """Rows count from 1, columns from 0 in bytes."""
    return [row["start_row"] + 1, row["start_col"], row["end_row"] + 1, row["end_col"]]


def lean(value: dict) -> dict:
    """Without what is missing, false or empty."""
    return {k: v for k, v in value.items() if v is not None and v is not False and v != "" and v != [] and v != {}}


def hoisted(rows: list[dict], keys: tuple[str, ...]) -> tuple[dict, list[dict]]:
    """Values that all rows share move out of them."""
    shared = {k: rows[0][k] for k in keys if rows and all(r.get(k) == rows[0].get(k) for r in rows) and rows[0].get(k)}
    return shared, [{k: v for k, v in r.items() if k not in shared} for r in rows]


def warning(returned: int, total: int | None, next_offset: int | None, counts: bool = False) -> str | None:
    """Only where there is a next page."""
    if next_offset is None:
        return None
    extent = f"this page holds {returned} of {total} rows" if total is not None else "there are more rows after this page"
    exact = "; counts_only gives exact counts without rows" if counts else ""
    return f"Incomplete: {extent}. Counts and lists taken from it are incomplete too. Go on at offset {next_offset} until truncated is false{exact}."


def diagnostic(code: str, message: str, hint: str, kinds: dict[str, int] | None = None) -> dict:
    return lean({"code": code, "message": message, "hint": hint, "kinds": kinds})


def aliased(value, names: dict[str, str]):
    """The value with every ``repo`` in it renamed."""
    if isinstance(value, dict):
        return {k: names.get(v, v) if k == "repo" and isinstance(v, str) else aliased(v, names) for k, v in value.items()}
    return [aliased(v, names) for v in value] if isinstance(value, list) else value


def shrunk(build, start: int, budget: int, size=size_of) -> tuple[dict, int, bool]:
    """build(n) for the largest tried n whose size fits: (response, n, fits).  Each step scales n by how much it is over."""
    n, response = start, build(start)
    for _ in range(64):
        if not budget or size(response) <= budget or n <= 1:
            break
        n = max(1, min(n * budget // size(response), n - 1))
        response = build(n)
    return response, n, not budget or size(response) <= budget
