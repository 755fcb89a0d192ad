"""Shared DuckDB definitions: the same melody tables as ``melodyspark.sources.tables``."""

from __future__ import annotations

CTES = {
    "frames": """SELECT user_id AS recording_id, event_id AS frame_id, (epoch_us(ts) - 1704067200000000) / 1e6 / 21600.0::DOUBLE AS t,
        45 + (round(value * 100)::BIGINT % 4000) / 100.0::DOUBLE AS midi, event_type <> 'error' AS voiced,
        json_extract(props, '$.k')::DOUBLE / 100 AS rms, event_type FROM events""",
    "notes": """SELECT recording_id, frame_id, t AS onset, least(t + 0.2::DOUBLE + rms, lead(t) OVER (PARTITION BY recording_id ORDER BY t, frame_id)) AS "end",
        round_even(midi, 0)::INT AS midi, midi AS median, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS lyric, rms FROM frames WHERE voiced""",
    "beats": """SELECT recording_id, b::INT AS beat, b::DOUBLE AS t_start FROM (SELECT recording_id, floor(max(t))::INT AS last FROM frames GROUP BY 1), unnest(generate_series(0, last)) AS u(b)""",
    "lengths": "SELECT recording_id, max(t) + 2.0::DOUBLE AS length FROM frames GROUP BY 1",
    "secnotes": """SELECT *, floor(onset / 20)::INT AS section, floor(onset / 5)::INT AS line FROM notes""",
    "sections": """SELECT DISTINCT recording_id, section, section * 20.0::DOUBLE AS start, (section + 1) * 20.0::DOUBLE AS "end" FROM secnotes""",
    "readings": """SELECT recording_id, frame_id, 'a' AS reader, median FROM notes UNION ALL SELECT recording_id, frame_id, 'b', median + 0.1::DOUBLE FROM notes
        UNION ALL SELECT recording_id, frame_id, 'c', CASE WHEN frame_id % 7 = 0 THEN median + 12 ELSE median + 0.05::DOUBLE END FROM notes""",
    "chart_old": "SELECT * FROM notes WHERE frame_id % 11 <> 0",
    "chart_new": "SELECT * REPLACE (CASE WHEN frame_id % 13 = 0 THEN midi + 1 ELSE midi END AS midi) FROM notes",
    "words": """SELECT d.doc_id AS recording_id, (pos - 1)::INT AS pos, w[pos] AS word, (pos - 1) * 0.4::DOUBLE AS start, (pos - 1) * 0.4::DOUBLE + 0.3::DOUBLE AS "end",
        coalesce(q, 0.5)::DOUBLE AS p, ((pos - 1) // 12)::INT AS segment
        FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents) d LEFT JOIN (SELECT doc_id, max(quality)::DOUBLE AS q FROM labels GROUP BY doc_id) l USING (doc_id),
        unnest(range(1, len(w) + 1)) AS u(pos)""",
    "score": """SELECT o_custkey AS song, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, (48 + o_orderkey % 24)::INT AS midi,
        (1 + o_orderkey % 3)::INT AS dur, o_orderkey % 5 = 0 AS tie, o_orderkey FROM orders""",
}
NEEDS = {"notes": ["frames"], "beats": ["frames"], "lengths": ["frames"], "secnotes": ["frames", "notes"], "sections": ["frames", "notes", "secnotes"], "readings": ["frames", "notes"], "chart_old": ["frames", "notes"], "chart_new": ["frames", "notes"]}


def r(x: str, places: int) -> str:
    """Half-to-even rounding by way of whole numbers."""
    return f"(round_even(({x}) * 1e{places}, 0) / 1e{places})"


def duck(*names: str, body: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """A statement: shared definitions (with what they need), own definitions, then the body."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (more or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body if parts else body


def case_list(values: list, index: str) -> str:
    """The element of a literal list at a 0-based index."""
    return "list_extract([" + ", ".join(repr(v) if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in values) + f"], ({index}) + 1)"
