"""DuckDB SQL that the queries are held against."""

from __future__ import annotations


#: Each part to the next one of the same order, parallel edges as they come.
MULTIGRAPH = """SELECT src, tgt, weight FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS tgt, l_quantity AS weight FROM lineitem) t WHERE tgt IS NOT NULL AND src <> tgt"""


def parts_in_order() -> str:
    return f"SELECT src, tgt, min(weight) AS weight FROM ({MULTIGRAPH}) GROUP BY src, tgt"



#: The graph of all orders as g, its edges numbered as e, its start vertex as s, its vertices as v.
G = f"g AS MATERIALIZED ({parts_in_order()})"
E = "e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY src, tgt) - 1 AS seq FROM g)"
S = "s AS MATERIALIZED (SELECT src AS id FROM g GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
V = "v AS MATERIALIZED (SELECT src AS id FROM g UNION SELECT tgt FROM g)"
SYM = "h AS MATERIALIZED (SELECT src, tgt, weight FROM g UNION ALL SELECT tgt, src, weight FROM g)"


def fixpoint(init: str, message: str, fold: str, edges: str = "g", key: str = "", keyed: bool = True, name: str = "r", kind: str = "BIGINT") -> str:
    """Recursive CTE (key, id, value): messages along the edges of what changed, folded, until no value improves.

    ``keyed``: the edges have the key too.
    """
    better, cols = "<" if fold == "min" else ">", f"{key}, id, value" if key else "id, value"
    k = f"r.{key}, " if key else ""
    on = f" AND r.{key} = x.{key}" if key and keyed else ""
    same = f" AND c.{key} = m.{key}" if key else ""
    return f"""{name}({cols}) USING KEY ({f'{key}, id' if key else 'id'}) AS ({init} UNION ALL
        SELECT {f'm.{key}, ' if key else ''}m.id, m.value FROM (SELECT {k}x.tgt AS id, {fold}({message}) AS value FROM {name} r JOIN {edges} x ON r.id = x.src{on} GROUP BY {k}x.tgt) m
        LEFT JOIN recurring.{name} c ON c.id = m.id{same} WHERE c.id IS NULL OR m.value {better} c.value)"""


def ranks(n: int = 10, edges: str = "g", name: str = "p") -> str:
    out = [f"{name}d AS MATERIALIZED (SELECT src, count(*) AS d FROM {edges} GROUP BY src)", f"{name}v AS MATERIALIZED (SELECT src AS id FROM {edges} UNION SELECT tgt FROM {edges})", f"{name}0 AS MATERIALIZED (SELECT id, CAST(1 AS DOUBLE) AS rank FROM {name}v)"]
    for i in range(1, n + 1):
        out.append(
            f"{name}{i} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(m.r, 0) AS rank FROM {name}v v LEFT JOIN (SELECT x.tgt, sum(p.rank * (1.0::DOUBLE / d.d)) AS r "
            f"FROM {name}{i - 1} p JOIN {edges} x ON x.src = p.id JOIN {name}d d ON d.src = p.id GROUP BY x.tgt) m ON m.tgt = v.id)"
        )
    return ", ".join(out)


def quant(column: str, name: str = "rank_q") -> str:
    return f"CAST(floor({column} * 1e6 + 0.3137) AS BIGINT) AS {name}"


BFS_FIX = fixpoint("SELECT id, CAST(0 AS BIGINT) AS value FROM s", "r.value + 1", "min")
CC_FIX = fixpoint("SELECT id, id AS value FROM v", "r.value", "min")
SSSP_FIX = fixpoint("SELECT id, CAST(0 AS DOUBLE) AS value FROM s", "r.value + x.weight", "min")
SSWP_FIX = fixpoint("SELECT id, CAST('infinity' AS DOUBLE) AS value FROM s", "least(r.value, x.weight)", "max")
BFS = f"WITH RECURSIVE {G}, {S}, {BFS_FIX} SELECT id, value AS dist FROM r"
CC = f"WITH RECURSIVE {G}, {V}, {CC_FIX} SELECT id, value AS label FROM r"
SSSP = f"WITH RECURSIVE {G}, {S}, {SSSP_FIX} SELECT id, value AS dist FROM r"
SSWP = f"WITH RECURSIVE {G}, {S}, {SSWP_FIX} SELECT id, value AS width FROM r WHERE value < 'infinity'::DOUBLE"
PAGERANK = f"WITH {G}, {ranks()} SELECT id, {quant('rank')} FROM p10"
#: Improvements of at most 1 are taken but not passed on.
SSSP_DELTA = f"""WITH RECURSIVE {G}, {S}, r(id, value, far) USING KEY (id) AS (SELECT id, CAST(0 AS DOUBLE) AS value, true AS far FROM s UNION ALL
        SELECT m.id, m.value, c.id IS NULL OR m.value < c.value - 1 FROM (SELECT x.tgt AS id, min(r.value + x.weight) AS value FROM r JOIN g x ON r.id = x.src WHERE r.far GROUP BY x.tgt) m
        LEFT JOIN recurring.r c ON c.id = m.id WHERE c.id IS NULL OR m.value < c.value) SELECT id, value AS dist FROM r"""

#: Four batches of inserts; each batch also deletes some of the edges that the one before inserted.
LOG = "b AS MATERIALIZED (SELECT *, seq * 4 // (SELECT count(*) FROM g) AS batch, (src * 31 + tgt * 17) % 100 AS h FROM e)"
LIVE = "le AS MATERIALIZED (SELECT CAST(k.k AS BIGINT) AS batch_id, src, tgt, weight FROM b JOIN range(0, 4) k(k) ON b.batch <= k.k AND NOT (h < 2 AND b.batch <= k.k - 1))"


def evolving(init: str, message: str, fold: str, column: str, where: str = "") -> str:
    return f"WITH RECURSIVE {G}, {E}, {S}, {LOG}, {LIVE}, {fixpoint(init, message, fold, 'le', 'batch_id')} SELECT batch_id, id, value AS {column} FROM r {where}"


STARTS = "SELECT CAST(k AS BIGINT) AS batch_id, id, CAST({0}) AS value FROM s, range(0, 4) t(k)"
LABELS = "SELECT DISTINCT batch_id, id, id AS value FROM (SELECT batch_id, src AS id FROM le UNION ALL SELECT batch_id, tgt FROM le)"


def delta_ranks(graph: str, deltas: tuple[float, ...], name: str, n: int = 10) -> str:
    """CTEs up to <name><n> (delta, id, rank, send): changes above delta times the rank are passed on, the others lost."""
    values = ", ".join(f"(CAST({d} AS DOUBLE))" for d in deltas)
    out = [
        f"{name}d AS MATERIALIZED (SELECT src, count(*) AS d FROM {graph} GROUP BY src)",
        f"{name}0 AS MATERIALIZED (SELECT delta, id, CAST(0 AS DOUBLE) AS rank, CAST(1 AS DOUBLE) AS send FROM (SELECT src AS id FROM {graph} UNION SELECT tgt FROM {graph}), (VALUES {values}) t(delta))",
    ]
    for k in range(1, n + 1):
        base, less = (" + 0.15::DOUBLE", " - 1") if k == 1 else ("", "")
        out.append(
            f"{name}{k} AS MATERIALIZED (SELECT delta, id, rank, CASE WHEN abs(d) > delta * rank THEN d ELSE 0 END AS send FROM (SELECT p.delta, p.id, p.rank + (coalesce(m.s, 0){base}) AS rank, coalesce(m.s, 0){base}{less} AS d "
            f"FROM {name}{k - 1} p LEFT JOIN (SELECT p.delta, x.tgt, 0.85::DOUBLE * sum(p.send * (1.0::DOUBLE / d.d)) AS s FROM {name}{k - 1} p JOIN {graph} x ON x.src = p.id JOIN {name}d d ON d.src = p.id "
            f"WHERE p.send <> 0 GROUP BY p.delta, x.tgt) m ON m.tgt = p.id AND m.delta = p.delta))"
        )
    return ", ".join(out)


def mix64(x: str) -> str:
    """The 64-bit finaliser over unsigned numbers; products are taken in 128 bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = f"CAST(CAST(xor({x}, {x} >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT % {1 << 64}::UHUGEINT AS UBIGINT)"
    return f"xor({x}, {x} >> 31)"


def unit(h: str) -> str:
    return f"(CAST({h} >> 11 AS DOUBLE) / {1 << 53}::DOUBLE)"
