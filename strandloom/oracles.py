"""DuckDB SQL for the registered queries of the variant engine, written independently of the DataFrame code."""

from __future__ import annotations

from strandloom import derived as D
from strandloom.sources.reference import CHUNK

_GQX = "CASE WHEN qual <> '.' AND gq <> '.' THEN least(TRY_CAST(qual AS INT), TRY_CAST(gq AS INT)) END"
_FAILS = """list_filter([
  CASE WHEN NOT indel AND mq + MQ_UP < 20 THEN 'LowMQ' END, CASE WHEN qd < 3.73 THEN 'LowQD' END, CASE WHEN NOT indel AND fs > 60 THEN 'HighFS' END,
  CASE WHEN indel AND fs > 200 THEN 'HighIndelFS' END], lambda x: x IS NOT NULL)"""
_LINE = "chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || qual || chr(9) || filter || chr(9) || info || chr(9) || format || chr(9) || sample"


def _labels(labels: str) -> str:
    """The FILTER list after ``labels`` were added to it."""
    had = "CASE WHEN filter IN ('PASS', '.') THEN [] ELSE [filter] END"
    return f"CASE WHEN len({labels}) > 0 THEN list_concat({had}, {labels}) WHEN filter = '.' THEN [] ELSE [filter] END"


_CALLS = f"WITH {D.CALLS}, k AS (SELECT *, {_GQX} AS gqx, length(ref) > 1 OR length(alt) > 1 AS indel FROM calls)"
# groomed records, with fields kept apart
_GROOMED = f"""{_CALLS}, groomed AS (SELECT line_no, chrom, pos, ref, alt, qual, indel, gqx, gt, gq, dp, ad0, dpi, mq + 1 AS mq, qd, fs,
  CASE WHEN len(given) > 0 THEN list_concat(CASE WHEN filter IN ('PASS', '.') THEN [] ELSE [filter] END, given) WHEN filter = '.' THEN ['PASS'] ELSE [filter] END AS filters
  FROM (SELECT *, list_concat(CASE WHEN gqx IS NULL OR gqx < 20 THEN ['LowGQX'] ELSE [] END, {_FAILS.replace('MQ_UP', '1')}) AS given FROM k)),
ready AS (SELECT *, 'MQ=' || mq || ';QD=' || qd || ';FS=' || fs || ';DP=' || dpi AS info,
  gt IN ('', './.', '.', '0/0', '0') AND alt = '.' AND length(ref) = 1 AND NOT (CAST(ad0 AS DOUBLE) / dpi + 0.2 <= 1.0) AS blockable,
  TRY_CAST(dp AS INT) AS dpn FROM groomed)"""
_READY = _GROOMED


def _islands(ready: str) -> str:
    return f"""{ready}, w AS (SELECT *, coalesce(dpn <> 0, false) AS covered FROM ready),
x AS (SELECT *, CASE WHEN blockable AND lag(blockable) OVER o AND lag(pos) OVER o = pos - 1 AND lag(filters) OVER o = filters AND lag(gt) OVER o = gt AND lag(covered) OVER o = covered THEN 0 ELSE 1 END AS fresh FROM w WINDOW o AS (PARTITION BY chrom ORDER BY pos)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY pos) AS island FROM x)"""


_ISLANDS = _islands(_READY)


#: The tolerance fold, a row at a time.
_FOLD = """, rowed AS (SELECT *, row_number() OVER (PARTITION BY chrom, island ORDER BY pos) AS rn FROM islands WHERE blockable),
fold AS (
  SELECT chrom, island, rn, pos, pos AS block, dpn AS f_dp, gqx AS f_gqx, mq AS f_mq, dpn AS lo_dp, dpn AS hi_dp, gqx AS lo_gqx, gqx AS hi_gqx, mq AS lo_mq, mq AS hi_mq FROM rowed WHERE rn = 1
  UNION ALL
  SELECT chrom, island, rn, pos, CASE WHEN joins THEN block ELSE pos END, CASE WHEN joins THEN f_dp ELSE dpn END, CASE WHEN joins THEN f_gqx ELSE gqx END, CASE WHEN joins THEN f_mq ELSE mq END,
    CASE WHEN joins THEN least(lo_dp, dpn) ELSE dpn END, CASE WHEN joins THEN greatest(hi_dp, dpn) ELSE dpn END, CASE WHEN joins THEN least(lo_gqx, gqx) ELSE gqx END, CASE WHEN joins THEN greatest(hi_gqx, gqx) ELSE gqx END,
    CASE WHEN joins THEN least(lo_mq, mq) ELSE mq END, CASE WHEN joins THEN greatest(hi_mq, mq) ELSE mq END
  FROM (SELECT r.chrom, r.island, r.rn, r.pos, r.dpn, r.gqx, r.mq, f.block, f.f_dp, f.f_gqx, f.f_mq, f.lo_dp, f.hi_dp, f.lo_gqx, f.hi_gqx, f.lo_mq, f.hi_mq,
    NOT r.covered OR (
      (r.gqx IS NULL OR f.f_gqx IS NULL OR TOL(least(f.lo_gqx, r.gqx), greatest(f.hi_gqx, r.gqx)))
      AND TOL(least(f.lo_dp, r.dpn), greatest(f.hi_dp, r.dpn)) AND TOL(least(f.lo_mq, r.mq), greatest(f.hi_mq, r.mq))) AS joins
    FROM fold f JOIN rowed r ON r.chrom = f.chrom AND r.island = f.island AND r.rn = f.rn + 1)),
placed AS (SELECT r.*, f.block FROM rowed r JOIN fold f USING (chrom, island, rn))"""


def _tolerances(sql: str) -> str:
    """``TOL(low, high)`` written out; the arguments hold one level of brackets."""
    out, at = "", 0
    while (start := sql.find("TOL(", at)) >= 0:
        depth, end, comma = 1, start + 4, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            comma = end if depth == 1 and sql[end] == "," else comma
            end += 1
        low, high = sql[start + 4 : comma], sql[comma + 1 : end - 1]
        out += sql[at:start] + f"({low} + 3 >= {high} OR (floor({low} * 0.3) > 3 AND {low} + floor({low} * 0.3) >= {high}))"
        at = end
    return out + sql[at:]


def _blocks(ready: str) -> str:
    return _tolerances(_islands(ready).replace("WITH ", "WITH RECURSIVE ", 1) + _FOLD)


_BLOCKS = _blocks(_READY)

def _settled(deep: str, depths: str = "") -> str:
    """Groomed records after those around indels were made consistent, as ``ready``; ``deep`` says whether a record is too deep."""
    labels = "list_concat(CASE WHEN {gqx} IS NULL OR {gqx} < 20 THEN ['LowGQX'] ELSE [] END, CASE WHEN deep THEN ['MaxDepth'] ELSE [] END, fails)"
    return f"""{_CALLS}{depths}, g0 AS (SELECT *, {deep} AS deep, {_FAILS.replace('MQ_UP', '1')} AS fails FROM k{' JOIN d USING (chrom)' if depths else ''}),
g1 AS (SELECT *, {labels.format(gqx='gqx')} AS given FROM g0),
g2 AS (SELECT *, CASE WHEN len(given) > 0 THEN list_concat(CASE WHEN filter IN ('PASS', '.') THEN [] ELSE [filter] END, given) WHEN filter = '.' THEN ['PASS'] ELSE [filter] END AS f0, CASE WHEN indel THEN pos + length(ref) - 1 END AS fin FROM g1),
u AS (SELECT *, max(fin) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g2),
v AS (SELECT *, sum(CASE WHEN indel AND (reach IS NULL OR pos + 2 > reach) THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS buffer, indel OR coalesce(pos <= reach, false) AS buffered FROM u),
grp AS (SELECT chrom, buffer, count(*) FILTER (buffered) AS members, count(*) FILTER (indel) AS indels, count(*) FILTER (NOT buffered) AS behind, min(pos) FILTER (indel) AS open_pos, max(greatest(fin, coalesce(reach, fin))) FILTER (indel) AS span_end,
  arg_min(f0, pos) FILTER (indel) AS sole_f, arg_min(gt, pos) FILTER (indel) AS sole_gt FROM v WHERE buffer > 0 GROUP BY chrom, buffer),
lst AS (SELECT chrom, max(buffer) AS buffer FROM grp GROUP BY chrom),
jdg AS (SELECT grp.* FROM grp JOIN lst USING (chrom) WHERE members > 1 AND (behind > 0 OR grp.buffer = lst.buffer)),
w1 AS (SELECT v.*, coalesce(v.buffered AND v.pos BETWEEN j.open_pos + 1 AND j.span_end, false) AS change, j.indels = 1 AS one, j.sole_f, j.indels = 1 AND j.sole_gt IN ('0/1', '1/0') AS half FROM v LEFT JOIN jdg j ON v.chrom = j.chrom AND v.buffer = j.buffer),
w2 AS (SELECT *, change AND half AND gt IN ('0/0', '1/1') AS hap, change AND half AND gt = '0/1' AS conf FROM w1),
w3 AS (SELECT *, change AND NOT hap AS unk, CASE WHEN change THEN list_filter(list_concat(CASE WHEN NOT one THEN ['IndelConflict'] WHEN sole_f = ['PASS'] THEN [] ELSE sole_f END, CASE WHEN conf THEN ['SiteConflict'] ELSE [] END), lambda l: NOT list_contains(f0, l)) ELSE [] END AS more FROM w2),
w4 AS (SELECT *, CASE WHEN len(more) > 0 THEN list_concat(CASE WHEN f0 = ['PASS'] THEN [] ELSE f0 END, more) ELSE f0 END AS f1, CASE WHEN NOT unk THEN gqx END AS gqx2 FROM w3),
w5 AS (SELECT *, {labels.format(gqx='gqx2')} AS again FROM w4),
ready AS (SELECT line_no, chrom, pos, ref, alt, CASE WHEN unk THEN '.' ELSE qual END AS qual, indel, gqx2 AS gqx, CASE WHEN unk THEN '.' WHEN hap THEN gt[1] ELSE gt END AS gt, TRY_CAST(dp AS INT) AS dpn, mq + 1 AS mq,
  CASE WHEN NOT change OR len(again) = 0 THEN f1 ELSE list_concat(CASE WHEN f1 = ['PASS'] THEN [] ELSE f1 END, list_filter(again, lambda l: NOT list_contains(f1, l))) END AS filters,
  'MQ=' || (mq + 1) || ';QD=' || qd || ';FS=' || fs || ';DP=' || dpi AS info,
  'GT' || CASE WHEN unk THEN '' ELSE ':GQ' END || ':DP:AD' || CASE WHEN change THEN '' ELSE ':PL' END || ':MQ' AS format,
  CASE WHEN unk THEN '.' WHEN hap THEN gt[1] ELSE gt END || CASE WHEN unk THEN '' ELSE ':' || gq END || ':' || dp || ':' || ad0 || ',1' || CASE WHEN change THEN '' ELSE ':9' END || ':' || (mq + 1) AS sample,
  (unk OR hap AND gt = '0/0' OR NOT change AND gt IN ('./.', '0/0')) AND alt = '.' AND length(ref) = 1 AND NOT (CAST(ad0 AS DOUBLE) / dpi + 0.2 <= 1.0) AS blockable FROM w5)"""


_BUFFER_GROOM = _settled("false") + """ SELECT chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || qual || chr(9) || array_to_string(filters, ';') || chr(9) || info || chr(9) || format || chr(9) || sample AS line FROM ready"""
_BLOCK_VCF = _blocks(_settled("coalesce(TRY_CAST(dp AS INT) > depth * 3, false)", ", d AS (SELECT chrom, 10 + max(k) % 3 AS depth FROM k GROUP BY chrom)")) + """,
b AS (SELECT chrom, block, arg_min(ref, pos) AS ref, arg_min(filters, pos) AS filters, arg_min(gt, pos) AS gt, bool_or(covered) AS covered, count(*) AS size, count(dpn) AS n_dp, count(gqx) AS n_gqx, count(mq) AS n_mq, min(dpn) AS dpn, min(gqx) AS gqx, min(mq) AS mq FROM placed GROUP BY chrom, island, block),
c2 AS (SELECT *, list_concat(CASE WHEN size > 1 THEN ['END=' || (block + size - 1)] ELSE [] END, CASE WHEN covered AND (n_dp > 1 OR n_gqx > 1 OR n_mq > 1) THEN ['BLOCKAVG_min30p3a'] ELSE [] END) AS items FROM b)
SELECT chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || qual || chr(9) || array_to_string(filters, ';') || chr(9) || info || chr(9) || format || CASE WHEN gqx IS NULL THEN '' ELSE ':GQX' END || chr(9) || sample || CASE WHEN gqx IS NULL THEN '' ELSE ':' || gqx END AS line FROM ready WHERE NOT blockable
UNION ALL SELECT chrom || chr(9) || block || chr(9) || '.' || chr(9) || ref || chr(9) || '.' || chr(9) || '.' || chr(9) || array_to_string(filters, ';') || chr(9) || CASE WHEN len(items) = 0 THEN '.' ELSE array_to_string(items, ';') END || chr(9) || CASE WHEN covered THEN 'GT:DP:GQX:MQ' ELSE 'GT' END || chr(9) || gt || CASE WHEN covered THEN ':' || coalesce('' || dpn, '.') || ':' || coalesce('' || gqx, '.') || ':' || coalesce('' || mq, '.') ELSE '' END FROM c2"""

_MERGED = f"""{D.REGIONS}, mark AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY begin, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM regions),
num AS (SELECT *, sum(CASE WHEN reach IS NULL OR begin > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY begin, "end" ROWS UNBOUNDED PRECEDING) AS island FROM mark),
merged AS (SELECT chrom, min(begin) AS begin, max("end") AS "end" FROM num GROUP BY chrom, island)"""
_PIECES = f"""WITH {D.BLOCKS}, {_MERGED},
cut AS (SELECT k, pos AS c FROM blocks UNION SELECT k, m.begin + 1 FROM blocks b JOIN merged m ON b.chrom = m.chrom AND b.stop > m.begin AND b.pos <= m."end" WHERE m.begin + 1 > b.pos AND m.begin + 1 <= b.stop
  UNION SELECT k, m."end" + 1 FROM blocks b JOIN merged m ON b.chrom = m.chrom AND b.stop > m.begin AND b.pos <= m."end" WHERE m."end" + 1 > b.pos AND m."end" + 1 <= b.stop),
cuts AS (SELECT k, c, lead(c) OVER (PARTITION BY k ORDER BY c) - 1 AS upto FROM cut),
pieces AS (SELECT b.k, b.line_no, b.chrom, b.pos AS origin, b.stop AS last, b.filter, b.gt, b.n, c.c AS pos, coalesce(c.upto, b.stop) AS stop,
  EXISTS (SELECT 1 FROM merged m WHERE m.chrom = b.chrom AND c.c > m.begin AND c.c <= m."end") AS in_region,
  EXISTS (SELECT 1 FROM merged m WHERE m.chrom = b.chrom AND b.stop > m.begin AND b.pos <= m."end") AS touched
  FROM blocks b JOIN cuts c ON b.k = c.k)"""
_PIECE_INFO = "CASE WHEN NOT touched AND last > origin THEN 'END=' || last || ';X' WHEN NOT touched THEN '.' WHEN stop > pos THEN 'END=' || stop || CASE WHEN last > origin THEN ';X' ELSE '' END WHEN last > origin THEN 'X' ELSE '.' END"


def _piece_line(info: str, filter: str = "filter", format: str = "'GT:PL:DP'", sample: str = "gt || ':5:' || n") -> str:
    return f"chrom || chr(9) || pos || chr(9) || '.' || chr(9) || {D.base('pos')} || chr(9) || '.' || chr(9) || '.' || chr(9) || {filter} || chr(9) || {info} || chr(9) || {format} || chr(9) || {sample} AS line"


_SITES = f"""WITH {D.BLOCKS}, s AS (SELECT *, unnest(range(pos, stop + 1)) AS p FROM blocks)"""
_MERGE_BASE = f"""WITH {D.SAMPLES},
okay AS (SELECT *, filter = 'PASS' AND (gqx = '.' OR TRY_CAST(gqx AS INT) >= 20) AND gt <> './.' AS called, CAST(dp AS INT) <> 0 AS mapped,
  CASE WHEN gt IN ('0/0', '0/1') THEN {D.base('pos')} WHEN gt = './.' THEN 'N' ELSE alt END AS a1, CASE WHEN gt IN ('0/0', '1/0') THEN {D.base('pos')} WHEN gt = './.' THEN 'N' ELSE alt END AS a2, {D.base('pos')} AS ref_base FROM samples)"""


def _concordance(n: int, names: tuple[str, ...]) -> str:
    per = ", ".join(f"coalesce(bool_or(mapped) FILTER (sample_id = {k}), false) AS m{k}, coalesce(bool_or(called) FILTER (sample_id = {k}), false) AS c{k}, max(a1) FILTER (sample_id = {k}) AS x{k}, max(a2) FILTER (sample_id = {k}) AS y{k}" for k in range(n))
    every = lambda c: " AND ".join(f"{c}{k}" for k in range(n))
    some = lambda c: "(" + " OR ".join(f"{c}{k}" for k in range(n)) + ")"
    homs = " AND ".join(f"x{k} = y{k}" for k in range(n))
    state = "CASE WHEN (x0 = y0) <> (x1 = y1) THEN 'homhet' WHEN x0 = y0 THEN CASE WHEN x0 = x1 THEN 'samehom' ELSE 'diffhom' END WHEN x0 = x1 AND y0 = y1 THEN 'samehet' ELSE 'diffhet' END"
    fits = "(x0 = x1 AND y0 = y1) OR (y0 = x1 AND x0 = y1)" if n == 2 else "(x2 IN (x1, y1) AND y2 IN (x0, y0)) OR (x2 IN (x0, y0) AND y2 IN (x1, y1))"
    lead = "x0" if n == 2 else "x2"
    return f"""{_MERGE_BASE}, m AS (SELECT chrom, pos, any_value(ref_base) AS b, {per} FROM okay WHERE NOT indel AND ref_base <> 'N' AND sample_id < {n} GROUP BY chrom, pos),
j AS (SELECT *, {every('m')} AS all_mapped, {some('m')} AS any_mapped, {every('c')} AS all_called, {some('c')} AS any_called, {fits} AS fits, {state} AS state, ({homs} AND {lead} = b) AS is_ref FROM m),
judged AS (SELECT *, all_called AND fits AND NOT is_ref AS good, all_called AND NOT fits AS bad FROM j)"""


def _report(n: int, names: tuple[str, ...]) -> str:
    rows = [("some_mapped", "any_mapped AND NOT all_mapped"), ("all_mapped", "all_mapped"), ("some_called", "any_called AND NOT all_called"), ("all_called", "all_called"), ("incorrect", "bad"), ("snp_correct", "good")]
    for k, name in enumerate(names):
        snp = f"c{k} AND NOT (x{k} = b AND y{k} = b)"
        rows += [(f"mapped_{name}", f"m{k}"), (f"called_{name}", f"c{k}"), (f"snp_{name}", snp), (f"snp_het_{name}", f"{snp} AND x{k} <> y{k}"), (f"correct_het_{name}", f"good AND x{k} <> y{k}"), (f"correct_hom_{name}", f"good AND x{k} = y{k} AND x{k} <> b")]
    for state in ("samehom", "diffhom", "samehet", "diffhet", "homhet"):
        for child, test in (("_hom", " AND x2 = y2"), ("_het", " AND x2 <> y2")) if n == 3 else (("", ""),):
            rows += [(f"conflict_{state}{child}", f"bad AND state = '{state}'{test}"), (f"agree_{state}{child}", f"good AND state = '{state}'{test}")]
    return _concordance(n, names) + " " + " UNION ALL ".join(f"SELECT '{name}' AS metric, count(*) FILTER ({test}) AS value FROM judged" for name, test in rows)


_TRIO = _concordance(3, ("mother", "father", "child"))
_HETS = "good AND x0 <> y0 AND x1 <> y1"
_BUFFERS = f"""{_READY}, u AS (SELECT *, max(CASE WHEN indel THEN pos + length(ref) - 1 END) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ready),
v AS (SELECT *, sum(CASE WHEN indel AND (reach IS NULL OR pos + 2 > reach) THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS buffer, indel OR coalesce(pos <= reach, false) AS buffered FROM u)"""


_MERGE = f"""{_MERGE_BASE},
loci AS (SELECT chrom, pos, indel, any_value(ref) AS ref, any_value(ref_base) AS b, bool_or(called AND (a1 <> ref_base OR a2 <> ref_base)) AS varies, max(CASE WHEN gt LIKE '%1%' THEN alt END) AS alt,
  arg_min(s % 2, sample_id) AS order0, {", ".join(f"max(CASE WHEN sample_id = {k} THEN CASE WHEN gt = './.' THEN CASE WHEN indel THEN '0/0' ELSE '.' END ELSE gt END END) AS g{k}, max(CASE WHEN sample_id = {k} THEN gqx END) AS q{k}, max(CASE WHEN sample_id = {k} THEN dp END) AS d{k}" for k in range(3))}
  FROM okay GROUP BY chrom, pos, indel),
labels AS (SELECT chrom, pos, indel, string_agg(label, ';' ORDER BY place) AS filter FROM (SELECT chrom, pos, indel, label, min(place) AS place FROM
  (SELECT chrom, pos, indel, unnest(string_split(filter, ';')) AS label, sample_id * 10 + unnest(range(len(string_split(filter, ';')))) AS place FROM okay WHERE filter NOT IN ('PASS', '.')) GROUP BY chrom, pos, indel, label) GROUP BY chrom, pos, indel)"""
_GENOTYPES = " || chr(9) || ".join(f"CASE WHEN g{k} IS NULL THEN '.' WHEN order0 = 0 THEN g{k} || ':' || q{k} || ':' || d{k} ELSE g{k} || ':' || d{k} || ':' || q{k} END" for k in range(3))


_TWIN_LINES = f"""WITH r AS ({_report(2, ("twin1", "twin2"))}),
s AS (SELECT count(*) * {D.CONTIG} AS size, count(*) * ({D.CONTIG} - {D.CONTIG} // 97) AS known FROM (SELECT DISTINCT floor(l_orderkey / {D.SPAN}) FROM lineitem)),
v AS (SELECT size, known, map_from_entries((SELECT list((metric, value)) FROM r)) AS m FROM s),
q AS (SELECT *, m['snp_correct'] + m['incorrect'] AS snps FROM v)
"""


def _twin_lines() -> str:
    """The twins' report as text, from its counters."""
    names = ("twin1", "twin2")

    def of(name: str) -> str:
        return f"m['{name}']"

    def ratio(n: str, d: str) -> str:
        return f"format('{{:g}}', CASE WHEN {d} = 0 THEN 0.0::DOUBLE ELSE ({n}) / CAST({d} AS DOUBLE) END)"

    def hets(het: str, hom: str) -> str:
        return f"({het} + {hom}) || ' ' || {het} || ' ' || {hom} || ' ' || {ratio(het, hom)} || ' ' || {ratio(het, f'({het} + {hom})')}"

    lines = [("sites", "'' || size"), ("known_sites", "'' || known")]
    for kind in ("mapped", "called"):
        lines += [(f"sites_{kind}_{name}", f"'' || {of(f'{kind}_{name}')}") for name in names]
        some, both = of(f"some_{kind}"), of(f"all_{kind}")
        lines += [(f"sites_{kind}_in_no_samples", f"'' || (known - {some} - {both})"), (f"sites_{kind}_in_some_samples", f"'' || {some}"), (f"sites_{kind}_in_all_samples", f"'' || {both}")]
    lines += [("sites_called_in_all_samples_conflict", f"'' || {of('incorrect')}"), ("fraction_of_known_sites_called_in_all_samples", ratio(of("all_called"), "known"))]
    lines += [("fraction_of_sites_called_in_all_samples_in_conflict", ratio(of("incorrect"), of("all_called")))]
    for name in names:
        lines.append((f"sites_with_snps_called_total_het_hom_het/hom_P(het)_{name}", hets(of(f"snp_het_{name}"), f"({of(f'snp_{name}')} - {of(f'snp_het_{name}')})")))
        lines.append((f"snp_non_conflict_total_het_hom_het/hom_P(het)_{name}", hets(of(f"correct_het_{name}"), of(f"correct_hom_{name}"))))
    lines += [("sites_called_in_all_samples_with_snps_called_any_sample", "'' || snps"), ("fraction_of_snp_sites_in_conflict", ratio(of("incorrect"), "snps"))]
    for label, kind in (("snp_conflict_type", "conflict"), ("snp_non_conflict_type", "agree")):
        lines += [(f"{label}_{state}", f"'' || {of(f'{kind}_{state}')}") for state in ("samehom", "diffhom", "samehet", "diffhet", "homhet")]
    return _TWIN_LINES + " UNION ALL ".join(f"SELECT '{metric}' AS metric, {value} AS value FROM q" for metric, value in lines)


_RAW = ", ".join(f"max(CASE WHEN l.sample_id = {k} THEN l.value END) AS r{k}" for k in range(3))
_TRIO_EVENTS = f"""{_TRIO}, l AS ({D.SAMPLE_LINES}),
b AS (SELECT j.chrom, j.pos, {_RAW} FROM judged j JOIN okay o ON o.chrom = j.chrom AND o.pos = j.pos AND NOT o.indel JOIN l ON l.line_no = o.line_no AND l.sample_id = o.sample_id WHERE bad GROUP BY j.chrom, j.pos)
SELECT 'EVENT' || chr(9) || chrom || chr(9) || pos AS value FROM b UNION ALL SELECT 'mother' || chr(9) || chr(9) || r0 FROM b UNION ALL SELECT 'father' || chr(9) || chr(9) || r1 FROM b UNION ALL SELECT 'child' || chr(9) || chr(9) || r2 FROM b"""
_FASTA = f"""WITH c AS (SELECT DISTINCT CAST(floor(l_orderkey / {D.SPAN}) AS BIGINT) AS chrom_idx FROM lineitem), p AS (SELECT chrom_idx, unnest(range(1, {D.CONTIG} + 1)) AS p FROM c)
SELECT 'chr' || (chrom_idx + 1) AS chrom, chrom_idx, (p - 1) // {CHUNK} AS chunk, min(p) - 1 AS start, string_agg({D.base('p')}, '' ORDER BY p) AS seq FROM p GROUP BY chrom_idx, (p - 1) // {CHUNK}"""
_AVERAGE_DEPTH = """WITH reads AS (SELECT event_id % 90 + 10 + CASE WHEN user_id % 3 = 0 THEN user_id % 50 + 1 ELSE 0 END AS aligned, row_number() OVER (ORDER BY event_id) AS rn FROM events WHERE (user_id % 8) & 4 = 0 AND event_id % 11 <> 0),
m AS (SELECT count(*) AS n, avg(aligned) AS length FROM reads WHERE rn <= 200000)
SELECT 'chr' || s_suppkey AS chrom, round(s_suppkey * 5 * length / (s_suppkey * 17 + 10), 6) AS depth, n AS n_reads FROM supplier, m WHERE s_suppkey * 17 + 10 >= length"""


def oracle_sql() -> dict[str, str]:
    gt_variant = "alt <> '.' AND (gt LIKE '%1%')"
    line = f"SELECT {_LINE} AS line FROM calls"
    edited = "replace(replace(CASE WHEN k % 4 = 0 THEN 'MQ=' || mq || '.6;QD=7;FS=' || fs || ';DP=' || dpi ELSE 'MQ=' || mq || '.6;QD=7;FS=' || fs || ';DP=' || dpi END, 'x', 'x'), 'y', 'y') || ';FLAG'"
    haploid_same = "touched AND in_region AND gt IN ('./.', '0/0')"
    return {
        "extract_variants": f"WITH {D.CALLS} {line} WHERE {gt_variant}",
        "extract_nonvariants": f"WITH {D.CALLS} {line} WHERE NOT ({gt_variant})",
        "record_predicates": f"WITH {D.CALLS} SELECT line_no, {gt_variant} AS strict_variant, alt <> '.' AS variant, length(ref) > 1 OR length(alt) > 1 AS indel_block, alt <> '.' AND (length(ref) > 1 OR length(alt) <> length(ref)) AS indel_site, alt <> '.' AND length(alt) <> length(ref) AS indel_range, length(ref) <> 1 AND alt = '.' AS nonvariant_block, CASE WHEN alt <> '.' AND length(alt) <> length(ref) THEN pos + 1 ELSE pos END AS begin, CASE WHEN alt <> '.' AND length(alt) <> length(ref) THEN pos + length(ref) - 1 ELSE pos END AS \"end\" FROM calls",
        "parse_gt": f"WITH {D.CALLS} SELECT line_no, CASE gt WHEN './.' THEN -1 ELSE CAST(gt[1] AS INT) END AS first, CASE gt WHEN './.' THEN -1 ELSE CAST(gt[3] AS INT) END AS second, 2 AS n FROM calls",
        "numeric_parse": f"WITH {D.CALLS} SELECT line_no, TRY_CAST(qual AS DOUBLE) AS qual, CAST(ad0 AS INT) AS ad, CAST(mq + 1 AS INT) AS mq, CAST(qd AS DOUBLE) AS qd, CAST(12 AS BIGINT) AS prefix, CAST(NULL AS DOUBLE) AS strict FROM calls",
        "gqx_derive": f"{_CALLS} SELECT line_no, CAST(gqx AS DOUBLE) AS gqx FROM k",
        "field_edits": f"WITH {D.CALLS} SELECT chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || qual || chr(9) || filter || chr(9) || {edited} || chr(9) || 'GT:GQ:DP:ADX' || chr(9) || gt || ':1:' || dp || ':' || ad0 || ',1' AS line FROM calls",
        "threshold_filters": f"{_CALLS} SELECT line_no, array_to_string({_labels(_FAILS.replace('MQ_UP', '0.6'))}, ';') AS filters FROM k",
        "depth_filter": f"{_CALLS}, d AS (SELECT chrom, 10 + max(k) % 3 AS depth FROM k GROUP BY chrom) SELECT line_no, CASE WHEN dp <> '.' AND TRY_CAST(dp AS INT) > depth * 3 THEN CASE WHEN filter IN ('PASS', '.') THEN 'MaxDepth' ELSE filter || ';MaxDepth' END WHEN filter = '.' THEN '' ELSE filter END AS filters FROM k JOIN d USING (chrom)",
        "groom": f"{_READY} SELECT chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || qual || chr(9) || array_to_string(filters, ';') || chr(9) || info || chr(9) || 'GT:GQ:DP:AD:PL:MQ' || chr(9) || gt || ':' || gq || ':' || dp || ':' || ad0 || ',1:9:' || mq AS line FROM ready",
        "skip_repeats": f"{_CALLS} SELECT line_no, chrom, pos FROM k UNION ALL SELECT line_no + 1000000000, chrom, pos FROM k WHERE indel",
        "blockable": f"{_READY} SELECT line_no, blockable FROM ready",
        "indel_buffers": f"{_BUFFERS} SELECT line_no, CAST(buffer AS BIGINT) AS buffer, buffered FROM v",
        "indel_buffer_groom": _BUFFER_GROOM,
        "block_vcf": _BLOCK_VCF,
        "block_islands": f"{_ISLANDS} SELECT chrom, min(pos) AS begin, max(pos) AS \"end\", count(*) AS n FROM islands WHERE blockable GROUP BY chrom, island",
        "block_compress": f"{_BLOCKS} SELECT chrom, block AS begin, count(*) AS size, any_value(array_to_string(filters, ';')) AS filters, any_value(gt) AS gt, CAST(min(dpn) AS DOUBLE) AS min_dp, CAST(min(gqx) AS DOUBLE) AS min_gqx, CAST(min(mq) AS INT) AS min_mq, count(gqx) AS n_gqx FROM placed GROUP BY chrom, island, block",
        "block_stats": f"{_BLOCKS}, b AS (SELECT count(*) AS size, count(dpn) AS n_dp, stddev_samp(dpn) / sqrt(count(dpn)) AS se FROM placed WHERE covered GROUP BY chrom, island, block) SELECT count(*) AS blocks, round(avg(size), 6) AS size_mean, round(stddev_samp(size), 6) AS size_sd, min(size) AS size_min, max(size) AS size_max, round(avg(se) FILTER (n_dp >= 5), 6) AS mean_se_dp FROM b",
        "stream_stat": "SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 9) AS se, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY l_returnflag",
        "merge_regions": f'WITH {_MERGED} SELECT chrom, begin, "end" FROM merged',
        "called_regions": f"""WITH {D.CALLS}, r AS (SELECT chrom, CASE WHEN alt <> '.' AND length(alt) <> length(ref) THEN pos ELSE pos - 1 END AS begin, CASE WHEN alt <> '.' AND length(alt) <> length(ref) THEN pos + length(ref) - 1 ELSE pos END AS e FROM calls WHERE filter = 'PASS'),
m AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY begin, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE e > begin),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR begin > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY begin, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT chrom, min(begin) AS begin, max(e) AS "end" FROM n GROUP BY chrom, island""",
        "region_overlap": f'WITH {D.BLOCKS}, {_MERGED} SELECT line_no, chrom, pos FROM blocks b WHERE EXISTS (SELECT 1 FROM merged m WHERE m.chrom = b.chrom AND b.stop > m.begin AND b.pos <= m."end")',
        "region_pieces": f"{_PIECES} SELECT line_no, chrom, pos, stop, in_region FROM pieces",
        "remove_region": f"{_PIECES} SELECT {_piece_line(_PIECE_INFO)} FROM pieces WHERE NOT in_region",
        "break_blocks": f"{_PIECES}, single AS (SELECT chrom, unnest(range(pos, stop + 1)) AS pos, filter, gt, n, CASE WHEN last > origin THEN 'X' ELSE '.' END AS info FROM pieces WHERE in_region) SELECT {_piece_line(_PIECE_INFO)} FROM pieces WHERE NOT in_region UNION ALL SELECT {_piece_line('info')} FROM single",
        "break_blocks_on_target": f"{_PIECES}, single AS (SELECT chrom, unnest(range(pos, stop + 1)) AS pos, filter, gt, n, CASE WHEN last > origin THEN 'X' ELSE '.' END AS info FROM pieces WHERE in_region) SELECT {_piece_line('info')} FROM single",
        "set_haploid": f"""{_PIECES} SELECT {_piece_line(_PIECE_INFO, "CASE WHEN in_region AND gt = '0/1' THEN CASE WHEN filter IN ('PASS', '.') THEN 'HAPLOID_CONFLICT' ELSE filter || ';HAPLOID_CONFLICT' END ELSE filter END", f"CASE WHEN {haploid_same} THEN 'GT:DP:OPL' ELSE 'GT:PL:DP' END", f"CASE WHEN {haploid_same} THEN gt[1] || ':' || n || ':5' ELSE gt || ':5:' || n END")} FROM pieces""",
        "check_reference": f"WITH {D.CALLS} SELECT line_no, chrom, pos, ref, CASE WHEN length(ref) = 3 THEN {D.base('pos')} || {D.base('pos + 1')} || {D.base('pos + 2')} ELSE {D.base('pos')} END AS expected FROM calls WHERE ref <> CASE WHEN length(ref) = 3 THEN {D.base('pos')} || {D.base('pos + 1')} || {D.base('pos + 2')} ELSE {D.base('pos')} END",
        "ref_standardize": f"WITH {D.CALLS} SELECT line_no, chrom, ref || 'NNTN' AS seq, reverse(translate(ref, 'ACGT', 'TGCA')) AS reverse, CAST(instr('ACGTN', ref[1]) - 1 AS INT) AS code FROM calls",
        "reference_sizes": f"WITH {D.CALLS} SELECT DISTINCT chrom, CAST({D.CONTIG} AS BIGINT) AS size, CAST({D.CONTIG} - {D.CONTIG} // 97 AS BIGINT) AS known FROM calls",
        "site_expand": f"{_SITES} SELECT line_no, chrom, p AS pos, {D.base('p')} AS ref_base, filter = 'PASS' AND gt = '0/0' AS called, n AS depth FROM s",
        "site_expand_region": f"{_SITES} SELECT line_no, chrom, p AS pos FROM s WHERE chrom = 'chr2' AND p BETWEEN 500 AND 1500",
        "call_predicate": f"WITH {D.SAMPLES} SELECT sample_id, line_no, filter = 'PASS' AND (gqx = '.' OR TRY_CAST(gqx AS INT) >= 20) AND q >= 5 AND q <= 40 AS is_call, CAST(dp AS BIGINT) AS depth FROM samples",
        "murdock_dedupe": f"""WITH RECURSIVE {D.RANGES}, o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS rn FROM ranges),
f AS (SELECT chrom, rn, line_no, pos, true AS kept, stop AS last FROM o WHERE rn = 1 UNION ALL SELECT o.chrom, o.rn, o.line_no, o.pos, o.pos > f.last, CASE WHEN o.pos > f.last THEN o.stop ELSE f.last END FROM f JOIN o ON o.chrom = f.chrom AND o.rn = f.rn + 1)
SELECT line_no, chrom, pos FROM f WHERE kept""",
        "order_conflicts": f"WITH {D.RANGES}, o AS (SELECT line_no, pos, lag(stop) OVER (PARTITION BY chrom ORDER BY line_no) AS before FROM ranges) SELECT line_no FROM o WHERE pos <= before",
        "twins_report": _report(2, ("twin1", "twin2")),
        "trio_report": _report(3, ("mother", "father", "child")),
        "trio_conflicts": f"{_TRIO} SELECT chrom, pos, state, CASE WHEN x2 = y2 THEN 'hom' ELSE 'het' END AS child_state FROM judged WHERE bad",
        "trio_samehet": f"{_TRIO} SELECT chrom, pos FROM judged WHERE {_HETS} AND x2 <> y2 AND x0 = x1 AND x0 = x2 AND y0 = y1 AND y0 = y2",
        "trio_hethethom": f"{_TRIO} SELECT chrom, pos FROM judged WHERE {_HETS} AND x2 = y2 AND x2 <> b",
        "merge_variants": f"{_MERGE} SELECT l.chrom || chr(9) || l.pos || chr(9) || '.' || chr(9) || CASE WHEN l.indel THEN ref ELSE b END || chr(9) || coalesce(alt, '.') || chr(9) || '.' || chr(9) || coalesce(f.filter, 'PASS') || chr(9) || '.' || chr(9) || CASE WHEN order0 = 0 THEN 'GT:GQX:DP' ELSE 'GT:DP:GQX' END || chr(9) || {_GENOTYPES} AS line FROM loci l LEFT JOIN labels f ON l.chrom = f.chrom AND l.pos = f.pos AND l.indel = f.indel WHERE l.indel OR (b <> 'N' AND varies)",
        "avg_chrom_depth": _AVERAGE_DEPTH,
        "vcf_scan": f"WITH {D.CALLS} SELECT line, 'S1' AS sample_name FROM ({line})",
        "vcf_gzip_scan": f"WITH {D.CALLS} {line}",
        "vcf_region_scan": f"WITH {D.CALLS} SELECT line_no, chrom, pos FROM calls WHERE chrom = 'chr1' AND pos <= 9300 AND pos + length(ref) - 1 >= 8000",
        "vcf_chromosomes": f"WITH {D.CALLS} SELECT DISTINCT chrom FROM calls",
        "raw_scan": f"WITH {D.CALLS} {line} WHERE {gt_variant}",
        "fasta_scan": _FASTA,
        "bed_scan": f'WITH {_MERGED} SELECT chrom, begin, "end" FROM merged',
        "on_reference": f"WITH {D.CALLS} SELECT line_no, chrom, pos FROM calls WHERE chrom = 'chr1'",
        "without_chromosomes": f"WITH {D.CALLS} SELECT line_no, chrom, pos FROM calls WHERE chrom <> 'chr1'",
        "write_gqx": f"{_READY} SELECT line_no, 'GT:GQ:DP:AD:PL:MQ' || CASE WHEN gqx IS NULL THEN '' ELSE ':GQX' END AS format, gt || ':' || gq || ':' || dp || ':' || ad0 || ',1:9:' || mq || CASE WHEN gqx IS NULL THEN '' ELSE ':' || gqx END AS sample FROM ready",
        "twins_lines": _twin_lines(),
        "trio_events": _TRIO_EVENTS,
        "text_helpers": "SELECT s_suppkey, s_suppkey || '.vcf' AS name, '' || (s_suppkey - 5) AS text, s_suppkey % 3 = 1 AS has, round(CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_suppkey / CAST(s_suppkey % 4 AS DOUBLE) END, 9) AS ratio FROM supplier",
        "avg_depth_of_first_reads": _AVERAGE_DEPTH.replace("200000", "100"),
        "stream_variants": f"WITH {D.CALLS} {line} WHERE {gt_variant}",
        "chrom_depth_scan": "SELECT 'chr' || o_custkey % 25 AS chrom, CAST(arg_max(o_orderkey % 50, o_orderkey) AS DOUBLE) AS depth FROM orders GROUP BY o_custkey % 25",
    }
