"""What the clustering model does, as SQL for DuckDB: block by block, each from the state before it.

Every block chooses observers, lets the least used go, counts hits, links observers that are near
and hands colors on: each observer has a map from color to weight, clusters take over the colors of
greatest summed weight one to one, and their members' maps fade and gain one. Its rows, or those of
``predict``, are scored by the state after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.sampling import MODULUS, STEP


def model_sql(points: str, last: str, *, k: int, horizon: float, x: int, chi: int, zeta: float, size: int, idle: float, blocks: Sequence[str] = ("true",), predict: str | None = None, waves: tuple[int, float] | None = None, chance: int | None = None) -> str:
    """``points`` selects (idx, t, f), where an idx may repeat; ``blocks`` are conditions that part them in the order of time.

    ``last`` reads the tables ``answer`` (idx, label, score), ``model`` (oid, n, added, touched, label)
    and ``maps`` (oid, color, weight, ct, share). With ``waves`` (bins, highest frequency) the one block
    also counts phases; with ``chance`` (a seed) rows are sampled by digests of their index.
    """
    digest = f"(CAST('0x' || left(md5('{chance}:' || CAST(idx AS VARCHAR)), 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({16**13} AS DOUBLE)"

    def fade(now: str, then: str) -> str:
        return f"exp(-({now} - {then}) / CAST({horizon} AS DOUBLE))"

    def awake(source: str, now: str) -> str:
        age = f"1 - {fade('now', 'added')}"
        average = f"CASE WHEN {age} > 0 THEN n * {fade('now', 'touched')} / ({age}) ELSE CAST('inf' AS DOUBLE) END"
        ranked = f"SELECT s.*, row_number() OVER (ORDER BY {average} DESC, oid) AS rk, count(*) OVER () AS m FROM {source} s, {now}"
        return f"SELECT * EXCLUDE (rk, m), row_number() OVER (ORDER BY added, oid) AS place FROM ({ranked}) WHERE rk <= ceil(CAST(1 - {idle} AS DOUBLE) * m)"

    def nearest(rows: str, observers: str, rank: str) -> str:
        gaps = f"SELECT p.row, p.idx, p.t, o.*, list_distance(p.f, o.f) AS d FROM {rows} p JOIN {observers} o ON p.idx <> o.oid"
        return f"SELECT row, idx, t, oid, d FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY round({rank}, 9), place) AS rk FROM ({gaps})) WHERE rk <= {x}"

    bins, top = waves or (0, 0.0)
    turns = [f"CAST({top} AS DOUBLE) * {i} / {max(1, bins - 1)} * t" for i in range(bins)]
    base = "greatest(sqrt(re0 * re0 + im0 * im0), CAST(1e-12 AS DOUBLE))"
    dense = " + ".join(f"(cos({a}) * re{i} + sin({a}) * im{i})" for i, a in enumerate(turns))
    before, after = ("d / CAST(0.05 AS DOUBLE)", f"d / greatest(({dense}) / {base} / {bins}, CAST(0.05 AS DOUBLE))") if waves else ("d", "d")
    sums = "".join(f", sum({fade('now', 't')} * cos({a})) AS re{i}, sum({fade('now', 't')} * sin({a})) AS im{i}" for i, a in enumerate(turns))
    kept_sums = "".join(f", coalesce({c}{i}, 0) AS {c}{i}" for i in range(bins) for c in ("re", "im"))

    steps = [
        ("pts", f"SELECT *, row_number() OVER () AS row FROM ({points})"),
        ("state0", "SELECT idx AS oid, f, CAST(0 AS DOUBLE) AS n, t AS added, t AS touched FROM pts WHERE false"),
        ("map0", "SELECT idx AS oid, CAST(0 AS BIGINT) AS color, t AS weight, t AS ct FROM pts WHERE false"),
        ("next0", "SELECT CAST(0 AS BIGINT) AS next"),
    ]
    for b, where in enumerate(blocks, 1):
        chosen = "true" if b == 1 else f"r < CAST({min(1.0, k / horizon)!r} AS DOUBLE)"
        rank = f"(idx % {MODULUS} * {STEP}) % {MODULUS} / CAST({MODULUS} AS DOUBLE)"
        if chance is not None:
            rank = f"ln(-ln({digest})) - t / CAST({horizon} AS DOUBLE)" if b == 1 else digest
        steps += [
            (f"part{b}", f"SELECT * FROM pts WHERE {where}"),
            (f"new{b}", f"""SELECT oid, f, added FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY added, f) AS rk FROM (
  SELECT idx AS oid, f, t AS added FROM (SELECT *, {rank} AS r FROM part{b}) WHERE {chosen} ORDER BY r, idx, t, f LIMIT {k})) WHERE rk = 1"""),
            (f"then{b}", f"SELECT max(t) AS now FROM (SELECT added AS t FROM new{b} UNION ALL SELECT touched FROM state{b - 1})"),
            (f"held{b}", f"""SELECT oid, f, n, added, touched FROM (
  SELECT *, row_number() OVER (ORDER BY n * {fade("now", "touched")} / greatest(1 - {fade("now", "added")}, CAST(1e-12 AS DOUBLE)), oid) AS rk FROM state{b - 1}, then{b})
  WHERE rk > (SELECT count(*) FROM state{b - 1}) + (SELECT count(*) FROM new{b}) - {k}
  UNION ALL SELECT oid, f, CAST(0 AS DOUBLE), added, added FROM new{b}"""),
            (f"now{b}", f"SELECT max(t) AS now FROM (SELECT t FROM part{b} UNION ALL SELECT touched FROM held{b})"),
            (f"awake{b}", awake(f"held{b}", f"now{b}")),
            (f"near{b}", nearest(f"part{b}", f"awake{b}", before)),
            (f"hits{b}", f"SELECT oid, sum({fade('now', 't')}) AS hits{sums} FROM near{b}, now{b} GROUP BY oid"),
            (f"counted{b}", f"SELECT oid, f, n * {fade('now', 'touched')} + coalesce(hits, 0) AS n, added, now AS touched{kept_sums} FROM held{b} LEFT JOIN hits{b} USING (oid), now{b}"),
            (f"act{b}", awake(f"counted{b}", f"now{b}")),
            (f"gap{b}", f"SELECT a.place AS a, b.place AS b, list_distance(a.f, b.f) AS d FROM act{b} a JOIN act{b} b ON a.place <> b.place"),
            (f"h{b}", f"SELECT a, d AS h FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d) AS rk FROM gap{b}) WHERE rk = {chi}"),
            (f"cut{b}", f"SELECT a AS place, CAST({zeta} AS DOUBLE) * h + CAST(1 - {zeta} AS DOUBLE) * avg(h) OVER () AS c FROM h{b}"),
            (f"edge{b}", f"SELECT a, b FROM gap{b} JOIN cut{b} p ON p.place = a JOIN cut{b} q ON q.place = b WHERE d < p.c AND d < q.c"),
            (f"reach{b}", f"SELECT place, place AS got FROM act{b} UNION SELECT r.place, e.b FROM reach{b} r JOIN edge{b} e ON e.a = r.got"),
            (f"comp{b}", f"SELECT oid, min(got) AS component FROM reach{b} JOIN act{b} USING (place) GROUP BY oid"),
            (f"ranked{b}", f"SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) AS rk FROM comp{b} GROUP BY component HAVING count(*) >= {size}"),
            (f"faded{b}", f"SELECT m.oid, color, weight, weight * {fade('now', 'ct')} AS w, ct FROM map{b - 1} m JOIN held{b} USING (oid), now{b}"),
            (f"claim{b}", f"""SELECT component, color, row_number() OVER (ORDER BY round(sum(w), 9) DESC, rk, color) AS pick
  FROM faded{b} JOIN comp{b} USING (oid) JOIN ranked{b} USING (component) GROUP BY component, rk, color"""),
            (f"paint{b}", f"""SELECT CAST(0 AS BIGINT) AS pick, CAST([] AS BIGINT[]) AS done, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS component, CAST(NULL AS BIGINT) AS color UNION ALL
  SELECT c.pick, CASE WHEN free THEN list_append(done, c.component) ELSE done END, CASE WHEN free THEN list_append(used, c.color) ELSE used END, CASE WHEN free THEN c.component END, CASE WHEN free THEN c.color END
  FROM (SELECT p.done, p.used, c.*, NOT list_contains(p.done, c.component) AND NOT list_contains(p.used, c.color) AS free FROM paint{b} p JOIN claim{b} c ON c.pick = p.pick + 1) c"""),
            (f"fresh{b}", f"""SELECT component, next + row_number() OVER (ORDER BY rk) - 1 AS color FROM ranked{b}, next{b - 1}
  WHERE component NOT IN (SELECT component FROM paint{b} WHERE component IS NOT NULL)"""),
            (f"given{b}", f"SELECT component, color FROM paint{b} WHERE component IS NOT NULL UNION ALL SELECT component, color FROM fresh{b}"),
            (f"next{b}", f"SELECT next + (SELECT count(*) FROM fresh{b}) AS next FROM next{b - 1}"),
            (f"named{b}", f"SELECT c.oid, g.color AS label FROM comp{b} c JOIN given{b} g USING (component)"),
            (f"map{b}", f"""SELECT oid, color, sum(weight) AS weight, max(ct) AS ct FROM (
  SELECT f.oid, f.color, CASE WHEN label IS NULL THEN weight ELSE w END AS weight, CASE WHEN label IS NULL THEN ct ELSE now END AS ct FROM faded{b} f LEFT JOIN named{b} USING (oid), now{b}
  UNION ALL SELECT oid, label, CAST(1 AS DOUBLE), now FROM named{b}, now{b}) GROUP BY oid, color"""),
            (f"share{b}", f"SELECT *, weight / sum(weight) OVER (PARTITION BY oid) AS share FROM map{b}"),
            (f"state{b}", f"SELECT oid, f, n, added, touched FROM counted{b}"),
        ]
        if predict is None or b == len(blocks):
            steps += [
                (f"seen{b}", f"SELECT * FROM pts WHERE {where if predict is None else predict}"),
                (f"by{b}", nearest(f"seen{b}", f"act{b}", after)),
                (f"vote{b}", f"SELECT row, color AS label, round(sum(share), 9) AS m FROM by{b} JOIN share{b} USING (oid) GROUP BY ALL"),
                (f"best{b}", f"SELECT row, label FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY m DESC, label) AS rk FROM vote{b}) WHERE rk = 1"),
                (f"answer{b}", f"SELECT idx, CAST(coalesce(label, -1) AS INTEGER) AS label, score FROM (SELECT row, idx, median(d) AS score FROM by{b} GROUP BY ALL) LEFT JOIN best{b} USING (row)"),
            ]
    n = len(blocks)
    answers = [name for name, _ in steps if name.startswith("answer")]
    steps.append(("answer", " UNION ALL ".join(f"SELECT * FROM {a}" for a in answers)))
    steps.append(("model", f"SELECT oid, n, added, touched, CAST(coalesce(label, -1) AS INTEGER) AS label FROM counted{n} LEFT JOIN named{n} USING (oid)"))
    steps.append(("maps", f"SELECT * FROM share{n}"))
    tables = [f"{name} AS ({sql})" if name.startswith(("reach", "paint")) else f"{name} AS MATERIALIZED ({sql})" for name, sql in steps]
    return "WITH RECURSIVE " + ",\n".join(tables) + "\n" + last
