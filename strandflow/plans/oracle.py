"""DuckDB SQL of the catalog's rows, written apart from the Spark operators: relational where those use arrays, whole contigs where those use pieces."""

from __future__ import annotations

from strandflow.functions.sequence import GENETIC_CODE, HURST_WIDTHS
from strandflow.operators.scan import FUSED

W, STEP = 2000, 500

DOCS = "doc_seq AS MATERIALIZED (SELECT doc_id, source, lang, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g')) AS seq FROM documents)"
CONTIGS = f"{DOCS}, contigs AS MATERIALIZED (SELECT source AS contig_id, string_agg(seq, '' ORDER BY doc_id) AS seq FROM doc_seq GROUP BY source)"
#: The host of all contigs: all of them one after the other. host_of tells each segment's host; a host is its own.
HOST = """host AS (SELECT 'host' AS contig_id, string_agg(seq, '' ORDER BY contig_id) AS seq FROM contigs), host_of AS (SELECT contig_id, 'host' AS host FROM contigs UNION ALL SELECT 'host', 'host')"""


def windows(name: str = "wins", of: str = "contigs", window: int = W, step: int = STEP) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT contig_id, k AS window_no, k * {step} AS start, least(k * {step} + {window}, length(seq)) AS \"end\", substr(seq, k * {step} + 1, {window}) AS seq "
        f"FROM (SELECT contig_id, seq, unnest(range(0, greatest(0, (length(seq) - {window}) // {step}) + 1)) AS k FROM {of} WHERE length(seq) > 0))"
    )


def grams(k: int, of: str = "wins", keys: str = "contig_id, window_no", every: int = 1) -> str:
    """keys, g, n of the k-mers that start at every places."""
    return f"(SELECT {keys}, g, count(*) AS n FROM (SELECT {keys}, substr(seq, i, {k}) AS g FROM (SELECT {keys}, seq, unnest(range(1, length(seq) - {k} + 2, {every})) AS i FROM {of})) GROUP BY {keys}, g)"


def codon_pairs(of: str = "wins", keys: str = "contig_id, window_no") -> str:
    return grams(6, of, keys, 3)


ENTROPY = "CASE WHEN sum(n) <= 1 THEN 0.0 ELSE log2(sum(n)) - sum(n * log2(n)) / sum(n) END"


def entropies(name: str, k: int, every: int = 1, of: str = "wins") -> str:
    return f"{name} AS (SELECT contig_id, window_no, {ENTROPY} AS h FROM {grams(k, of, every=every)} GROUP BY contig_id, window_no)"


def hurst(name: str = "hurst", of: str = "wins") -> str:
    widths = ", ".join(str(w) for w in HURST_WIDTHS[:24])
    return f"""
{name}_x AS (SELECT contig_id, window_no, length(seq) AS n, i - 1 AS pos, instr('ACGT', substr(seq, i, 1)) - 1 AS c FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM {of})),
{name}_b AS (SELECT x.contig_id, x.window_no, w, pos // w AS b, pos, c - avg(c) OVER (PARTITION BY x.contig_id, x.window_no, w, pos // w) AS d
  FROM {name}_x x, (SELECT unnest([{widths}]) AS w) WHERE w < n // 4 AND pos // w < (n - 1) // w),
{name}_c AS (SELECT contig_id, window_no, w, b, d, sum(d) OVER (PARTITION BY contig_id, window_no, w, b ORDER BY pos) AS walk FROM {name}_b),
{name}_r AS (SELECT contig_id, window_no, w, (max(walk) - min(walk)) / sqrt(sum(d * d) / (w - 1)) AS rs FROM {name}_c GROUP BY contig_id, window_no, w, b HAVING sum(d * d) > 1e-9),
{name}_m AS (SELECT contig_id, window_no, w, avg(rs) AS rs FROM {name}_r GROUP BY contig_id, window_no, w),
{name} AS (SELECT s.contig_id, s.window_no, CASE WHEN length(s.seq) < 64 OR count(m.w) < 3 THEN 0.5 ELSE greatest(0.0, least(1.0, regr_slope(ln(m.rs), ln(m.w)))) END AS h
  FROM {of} s LEFT JOIN {name}_m m USING (contig_id, window_no) GROUP BY s.contig_id, s.window_no, s.seq)"""


def period3(name: str = "ac", of: str = "wins") -> str:
    return f"""
{name}_l AS (SELECT contig_id, window_no, length(seq) AS n, list_transform(range(1, length(seq) + 1), lambda i: CAST(instr('ACGT', substr(seq, i, 1)) - 1 AS DOUBLE)) AS v FROM {of}),
{name}_v AS (SELECT contig_id, window_no, n, list_transform(v, lambda x: x - m) AS v FROM (SELECT *, list_avg(v) AS m FROM {name}_l)),
{name}_p AS (SELECT contig_id, window_no, lag, abs(list_inner_product(v[1:n - lag], v[lag + 1:n]) / nullif(list_inner_product(v, v), 0)) AS r FROM (SELECT *, unnest(range(1, least(30, n // 4))) AS lag FROM {name}_v WHERE n >= 24)),
{name} AS (SELECT s.contig_id, s.window_no, coalesce(sum(p.r) FILTER (WHERE lag % 3 = 0) / nullif(sum(p.r), 0), 0.0) AS h FROM {of} s LEFT JOIN {name}_p p USING (contig_id, window_no) GROUP BY s.contig_id, s.window_no)"""


def letters(of: str = "wins") -> str:
    share = lambda c: f"(length(seq) - length(replace(seq, '{c}', ''))) / length(seq)"
    return f"letters_{of} AS (SELECT contig_id, window_no, {share('A')} AS a, {share('C')} AS c, {share('G')} AS g, {share('T')} AS t FROM {of})"


SPINE2 = "spine2 AS (SELECT x || y AS g FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS x), (SELECT unnest(['A', 'C', 'G', 'T']) AS y))"
SPINE3 = "spine3 AS (SELECT x || y || z AS g, substr('" + GENETIC_CODE + "', CAST(16 * (instr('ACGT', x) - 1) + 4 * (instr('ACGT', y) - 1) + instr('ACGT', z) AS INT), 1) AS aa FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS x), (SELECT unnest(['A', 'C', 'G', 'T']) AS y), (SELECT unnest(['A', 'C', 'G', 'T']) AS z))"


def rho(name: str, of: str = "wins", one: str = "", two: str = "") -> str:
    """name: contig_id, window_no, g, rho over all 16 pairs."""
    return f"""
{name}_1 AS MATERIALIZED {one or grams(1, of)},
{name}_2 AS MATERIALIZED {two or grams(2, of)},
{name} AS (SELECT s.contig_id, s.window_no, p.g,
    CASE WHEN length(s.seq) < 10 OR x.n IS NULL OR y.n IS NULL THEN 1.0 ELSE coalesce(d.n, 0) / (length(s.seq) - 1) / (CAST(x.n AS DOUBLE) * y.n / length(s.seq) / length(s.seq)) END AS rho
  FROM {of} s CROSS JOIN spine2 p
  LEFT JOIN {name}_1 x ON x.contig_id = s.contig_id AND x.window_no = s.window_no AND x.g = p.g[1]
  LEFT JOIN {name}_1 y ON y.contig_id = s.contig_id AND y.window_no = s.window_no AND y.g = p.g[2]
  LEFT JOIN {name}_2 d ON d.contig_id = s.contig_id AND d.window_no = s.window_no AND d.g = p.g)"""


def rscu(name: str, of: str = "wins", three: str = "") -> str:
    """name: contig_id, window_no, g, rscu over all 64 codons."""
    return f"""
{name}_n AS {three or grams(3, of, every=3)},
{name}_s AS (SELECT s.contig_id, s.window_no, length(s.seq) // 3 AS codons, p.g, p.aa, coalesce(c.n, 0) AS n FROM {of} s CROSS JOIN spine3 p LEFT JOIN {name}_n c ON c.contig_id = s.contig_id AND c.window_no = s.window_no AND c.g = p.g),
{name} AS (SELECT contig_id, window_no, g, CASE WHEN codons < 10 THEN 1.0 ELSE coalesce(n / nullif(avg(n) OVER (PARTITION BY contig_id, window_no, aa), 0), 1.0) END AS rscu FROM {name}_s)"""


def host_grams(k: int, every: int = 1) -> str:
    """As grams, of the hosts' letters: substr on a string this long would start over for each k-mer."""
    g = " || ".join(f"c{x}" for x in range(k))
    return f"(SELECT contig_id, 0 AS window_no, {g} AS g, count(*) AS n FROM hostc WHERE c{k - 1} IS NOT NULL AND (i - 1) % {every} = 0 GROUP BY contig_id, {g})"


def profile(host: str = HOST) -> str:
    whole = "hostw AS MATERIALIZED (SELECT contig_id, 0 AS window_no, seq FROM host)"
    split = "hostl AS (SELECT contig_id, unnest(string_split(seq, '')) AS c0, generate_subscripts(string_split(seq, ''), 1) AS i FROM host)"
    ahead = ", ".join(f"lead(c0, {x}) OVER (PARTITION BY contig_id ORDER BY i) AS c{x}" for x in range(1, 6))
    letters_ = f"{split}, hostc AS MATERIALIZED (SELECT contig_id, i, c0, {ahead} FROM hostl)"
    return f"{host}, {whole}, {letters_}, {rho('host_rho', 'hostw', host_grams(1), host_grams(2))}, {rscu('host_rscu', 'hostw', host_grams(3, 3))}, host_pairs AS MATERIALIZED {host_grams(6, 3)}, host_size AS (SELECT contig_id, sum(n) AS size FROM host_pairs GROUP BY contig_id)"


def signals(name: str, of: str) -> str:
    """name: contig_id, window_no, start, end and the ten signals of every segment."""
    p = f"{name}_"
    return f"""
{entropies(p + 'h3', 3, of=of)}, {entropies(p + 'k1', 1, of=of)}, {entropies(p + 'k2', 2, of=of)}, {entropies(p + 'cod', 3, 3, of)}, {entropies(p + 'cp', 6, 3, of)},
{hurst(p + 'hurst', of)}, {period3(p + 'ac', of)}, {letters(of)}, {rho(p + 'rho', of)}, {rscu(p + 'rscu', of)},
{p}rhod AS (SELECT w.contig_id, w.window_no, sqrt(sum((w.rho - h.rho) ** 2)) AS d FROM {p}rho w JOIN host_of o USING (contig_id) JOIN host_rho h ON h.g = w.g AND h.contig_id = o.host GROUP BY w.contig_id, w.window_no),
{p}rscud AS (SELECT w.contig_id, w.window_no, sqrt(sum((w.rscu - h.rscu) ** 2)) AS d FROM {p}rscu w JOIN host_of o USING (contig_id) JOIN host_rscu h ON h.g = w.g AND h.contig_id = o.host GROUP BY w.contig_id, w.window_no),
{p}pn AS MATERIALIZED {codon_pairs(of)},
{p}pt AS (SELECT contig_id, window_no, sum(n) AS size FROM {p}pn GROUP BY contig_id, window_no),
{p}bins AS (SELECT t.contig_id, t.window_no, (coalesce(n.n, 0) / t.size + 1e-10) / (1 + 4096e-10) AS p, (coalesce(h.n, 0) / z.size + 1e-10) / (1 + 4096e-10) AS q
  FROM {p}pt t JOIN host_of o USING (contig_id) JOIN host_size z ON z.contig_id = o.host CROSS JOIN (SELECT a.g || b.g AS g FROM spine3 a, spine3 b) s LEFT JOIN {p}pn n ON n.contig_id = t.contig_id AND n.window_no = t.window_no AND n.g = s.g LEFT JOIN host_pairs h ON h.g = s.g AND h.contig_id = o.host),
{p}jsd AS (SELECT contig_id, window_no, sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2 AS d FROM {p}bins GROUP BY contig_id, window_no),
{name} AS MATERIALIZED (SELECT s.contig_id, s.window_no, s.start, s."end", l.c + l.g AS gc, h3.h / 6 AS h3, hu.h AS hurst, ac.h AS ac3, greatest(2 * k1.h - k2.h, 0) AS mi1, abs(l.a - l.t) + abs(l.c - l.g) AS c2,
    rd.d AS rho, j.d AS cpd, cd.d AS rscu_d, greatest(2 * co.h - cp.h, 0) AS codon_mi
  FROM {of} s JOIN letters_{of} l USING (contig_id, window_no) JOIN {p}h3 h3 USING (contig_id, window_no) JOIN {p}hurst hu USING (contig_id, window_no) JOIN {p}ac ac USING (contig_id, window_no)
  JOIN {p}k1 k1 USING (contig_id, window_no) JOIN {p}k2 k2 USING (contig_id, window_no) JOIN {p}cod co USING (contig_id, window_no) JOIN {p}cp cp USING (contig_id, window_no)
  JOIN {p}rhod rd USING (contig_id, window_no) JOIN {p}rscud cd USING (contig_id, window_no) JOIN {p}jsd j USING (contig_id, window_no))"""


NAMES = ("gc", "h3", "hurst", "ac3", "mi1", "c2", "rho", "cpd", "rscu_d", "codon_mi")


def baseline() -> str:
    """stats: a row a host, over all its whole windows."""
    stats = ", ".join(f"avg({s}) AS {s}_mean, greatest(stddev_pop({s}), 1e-6) AS {s}_std" for s in NAMES)
    return f"""{windows('hwin_all', 'host', W, W)}, hwin AS MATERIALIZED (SELECT * FROM hwin_all WHERE "end" - start = {W}), {signals('hsig', 'hwin')}, stats AS (SELECT contig_id AS host, {stats} FROM hsig GROUP BY contig_id)"""


def scan() -> str:
    z = ", ".join(f"abs({s} - {s}_mean) / {s}_std AS {s}" for s in NAMES)
    ranks = ", ".join(f"row_number() OVER (PARTITION BY contig_id ORDER BY round({s}, 9) DESC, start) AS r_{s}" for s in FUSED)
    geo = "round(exp((" + " + ".join(f"ln(greatest({s}, 0.01))" for s in FUSED) + f") / {len(FUSED)}), 9)"
    top = "list_sum(list_sort([" + ", ".join(f"r_{s}" for s in FUSED) + "])[1:3])"
    return f"""
{windows()}, full_wins AS MATERIALIZED (SELECT * FROM wins WHERE "end" - start = {W}), {signals('sig', 'full_wins')},
z0 AS (SELECT contig_id, window_no, start, "end", {z} FROM sig JOIN host_of USING (contig_id) JOIN stats USING (host)),
z AS MATERIALIZED (SELECT *, coalesce(abs(gc - lag(gc) OVER w) + abs(h3 - lag(h3) OVER w), 0.0) AS gradient FROM z0 WINDOW w AS (PARTITION BY contig_id ORDER BY start)),
ranked AS (SELECT *, {geo} AS geomean, count(*) OVER (PARTITION BY contig_id) AS nw, {ranks} FROM z),
fused AS (SELECT *, round(nw * 3.0::DOUBLE / {top}, 9) AS rankfusion FROM ranked),
tracks AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY geomean DESC, start) AS gr, row_number() OVER (PARTITION BY contig_id ORDER BY rankfusion DESC, start) AS fr FROM fused),
scored AS MATERIALIZED (SELECT *, nw / least(gr, fr) AS composite, CASE WHEN gr <= fr THEN 'geometric' ELSE 'rankfusion' END AS track FROM tracks)"""


#: Greedy suppression as it is defined: best first, a window goes if a kept one is closer than two steps.
SUPPRESSED = f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY composite DESC, start) AS o FROM scored),
greedy AS (
  SELECT contig_id, 0 AS o, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT contig_id FROM ordered)
  UNION ALL
  SELECT g.contig_id, n.o, CASE WHEN len(list_filter(g.kept, lambda c: abs(c - n.start) < {2 * STEP})) > 0 THEN g.kept ELSE list_append(g.kept, n.start) END
  FROM greedy g JOIN ordered n ON n.contig_id = g.contig_id AND n.o = g.o + 1),
final_kept AS (SELECT contig_id, unnest(arg_max(kept, o)) AS start FROM greedy GROUP BY contig_id),
kept AS (SELECT s.* FROM scored s JOIN final_kept k USING (contig_id, start))"""

CONTEXT = """
classed AS (SELECT *, CASE WHEN gradient > 2.0 AND (c2 > 1.5 OR ac3 > 1.5) THEN 'MOBILE_LIKE' WHEN hurst > 2.5 THEN 'STRUCTURAL'
  WHEN (gc > 1.5)::INT + (h3 > 1.5)::INT + (hurst > 1.5)::INT + (c2 > 1.5)::INT + (ac3 > 1.5)::INT >= 2 THEN 'ANOMALOUS' ELSE 'NORMAL' END AS context_class FROM kept),
beside AS (SELECT *, coalesce(sum((context_class <> 'NORMAL')::INT) OVER (PARTITION BY contig_id ORDER BY start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS l,
  coalesce(sum((context_class <> 'NORMAL')::INT) OVER (PARTITION BY contig_id ORDER BY start ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS r FROM classed),
context AS (SELECT *, CASE WHEN context_class IN ('MOBILE_LIKE', 'STRUCTURAL') THEN 1.0::DOUBLE WHEN l > 0 AND r > 0 THEN 1.0::DOUBLE + 0.04::DOUBLE * (l + r) ELSE 1.0::DOUBLE + 0.02::DOUBLE * (l + r) END AS context_boost FROM beside),
boosted AS (SELECT *, composite * context_boost AS boosted FROM context)"""

def features(name: str, of: str) -> str:
    """name: contig_id, window_no, i, value of the 22 features of every segment."""
    p = f"{name}_"
    plain = ["coalesce(l.c + l.g, 0)", "coalesce(h3.h, 0) / 6", "coalesce(h4.h, 0) / 8", "hu.h", f"CASE WHEN length(s.seq) <= 2 THEN 0 ELSE greatest(2 * coalesce(k1.h, 0) - coalesce(k2.h, 0), 0) END", "ac.h"]
    rows = ", ".join(f"{{'i': {i}, 'value': CAST({c} AS DOUBLE)}}" for i, c in enumerate(plain))
    joins = " ".join(f"LEFT JOIN {p}{x} {x} USING (contig_id, window_no)" for x in ("h3", "h4", "k1", "k2"))
    return f"""{letters(of)}, {entropies(p + 'h3', 3, of=of)}, {entropies(p + 'h4', 4, of=of)}, {entropies(p + 'k1', 1, of=of)}, {entropies(p + 'k2', 2, of=of)}, {hurst(p + 'hu', of)}, {period3(p + 'ac', of)}, {rho(p + 'rho', of)},
{name} AS MATERIALIZED (SELECT contig_id, window_no, x.i AS i, x.value AS value FROM (SELECT contig_id, window_no, unnest([{rows}]) AS x FROM {of} s JOIN letters_{of} l USING (contig_id, window_no) {joins} JOIN {p}hu hu USING (contig_id, window_no) JOIN {p}ac ac USING (contig_id, window_no))
  UNION ALL SELECT contig_id, window_no, 5 + row_number() OVER (PARTITION BY contig_id, window_no ORDER BY g), rho FROM {p}rho)"""


def vectors(name: str, of: str) -> str:
    """name: contig_id, window_no, z of the standardised features."""
    z = f"SELECT contig_id, window_no, i, coalesce((value - avg(value) OVER (PARTITION BY i)) / nullif(stddev_pop(value) OVER (PARTITION BY i), 0), 0) AS z FROM {of}"
    return f"{name} AS MATERIALIZED (SELECT contig_id, window_no, list(z ORDER BY i) AS z FROM ({z}) GROUP BY contig_id, window_no)"


def linkage(name: str, of: str, k: str, method: str, size: int = 22) -> str:
    """name: contig_id, window_no, cluster of plain agglomeration of the vectors of a table; labels in the order of the clusters' least vectors."""
    if method == "ward":
        centre = ", ".join(f"sum(w * z[{i}]) / sum(w)" for i in range(1, size + 1))
        cents = f"(SELECT label, sum(w) AS w, [{centre}] AS c FROM {name}_tree GROUP BY label)"
        best = f"SELECT a.label AS la, b.label AS lb FROM {cents} a JOIN {cents} b ON a.label < b.label ORDER BY 2 * a.w * b.w / (a.w + b.w) * list_distance(a.c, b.c) ** 2, la, lb LIMIT 1"
    else:
        best = f"SELECT a.label AS la, b.label AS lb FROM {name}_tree a JOIN {name}_tree b ON a.label < b.label GROUP BY a.label, b.label ORDER BY sum(a.w * b.w * list_distance(a.z, b.z)) / sum(a.w * b.w), la, lb LIMIT 1"
    return f"""{name}_points AS MATERIALIZED (SELECT row_number() OVER (ORDER BY z) - 1 AS p, CAST(count(*) AS DOUBLE) AS w, z FROM {of} GROUP BY z),
{name}_tree AS (SELECT 0 AS level, p, w, z, p AS label FROM {name}_points
  UNION ALL SELECT level + 1, p, w, z, CASE WHEN label = lb THEN la ELSE label END FROM {name}_tree, ({best}) WHERE level < (SELECT count(*) FROM {name}_points) - {k}),
{name}_last AS (SELECT z, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM {name}_tree WHERE level = (SELECT max(level) FROM {name}_tree)),
{name} AS MATERIALIZED (SELECT contig_id, window_no, CAST(cluster AS INT) AS cluster FROM {of} JOIN {name}_last USING (z))"""


def k_means(models: str, starts: int, rounds: int, of: str = "v", size: int = 22) -> str:
    """agreed and confusion (model, label, cluster, n) of plain k-means. models: SQL of model, k, without (a feature's number from 1 or null), x, y (labels or null) rows."""
    mean = ", ".join(f"avg(z[{i}])" for i in range(1, size + 1))
    given = """
given{r} AS MATERIALIZED (SELECT d.model, d.start, d.label, d.rid, min(struct_pack(d := list_distance(d.z, c.z) ** 2, c := c.c)) AS best FROM data d JOIN cents{r} c USING (model, start) GROUP BY d.model, d.start, d.label, d.rid),"""
    moved = """
cents{r} AS MATERIALIZED (SELECT o.model, o.start, o.c, coalesce(m.z, o.z) AS z FROM cents{p} o LEFT JOIN (SELECT model, start, best.c AS c, [{mean}] AS z FROM given{p} JOIN data USING (model, start, label, rid) GROUP BY model, start, best.c) m USING (model, start, c)),"""
    steps = given.format(r=0) + "".join(moved.format(r=r, p=r - 1, mean=mean) + given.format(r=r) for r in range(1, rounds + 1))
    return f"""models AS ({models}),
data AS MATERIALIZED (SELECT model, start, k, contig_id AS label, contig_id || ':' || window_no AS rid, CASE WHEN without IS NULL THEN z ELSE list_transform(range(1, {size + 1}), lambda i: CASE WHEN i = without THEN 0.0::DOUBLE ELSE z[i] END) END AS z
  FROM {of}, models, (SELECT unnest(range(0, {starts})) AS start) WHERE x IS NULL OR contig_id IN (x, y)),
cents0 AS MATERIALIZED (SELECT model, start, c, z FROM (SELECT model, start, k, row_number() OVER (PARTITION BY model, start ORDER BY md5(start || ':' || rid)) - 1 AS c, z FROM data) WHERE c < k),{steps}
chosen AS (SELECT model, arg_min(start, (cost, start)) AS start FROM (SELECT model, start, round(sum(best.d), 6) AS cost FROM given{rounds} GROUP BY ALL) GROUP BY model),
confusion AS MATERIALIZED (SELECT model, label, best.c AS cluster, CAST(count(*) AS DOUBLE) AS n FROM given{rounds} JOIN chosen USING (model, start) GROUP BY ALL),
agreed AS (SELECT model, n_all AS n, (cc - aa * bb / (n_all * (n_all - 1) / 2)) / nullif((aa + bb) / 2 - aa * bb / (n_all * (n_all - 1) / 2), 0) AS ari FROM (SELECT model, sum(n) AS n_all, sum(n * (n - 1) / 2) AS cc FROM confusion GROUP BY model)
  JOIN (SELECT model, sum(a * (a - 1) / 2) AS aa FROM (SELECT model, label, sum(n) AS a FROM confusion GROUP BY ALL) GROUP BY model) USING (model)
  JOIN (SELECT model, sum(b * (b - 1) / 2) AS bb FROM (SELECT model, cluster, sum(n) AS b FROM confusion GROUP BY ALL) GROUP BY model) USING (model))"""


SCAN = f"WITH RECURSIVE {CONTIGS}, {SPINE2}, {SPINE3}, {profile()}, {baseline()}, {scan()}"
GENES = f"""{DOCS},
placed AS (SELECT doc_id, source AS contig_id, length(seq) AS len, sum(length(seq)) OVER (PARTITION BY source ORDER BY doc_id) - length(seq) AS start FROM doc_seq),
genes AS (SELECT contig_id, doc_id AS gene_id, CAST(start AS BIGINT) AS start, CAST(start + len AS BIGINT) AS "end", coalesce(l.toxic, 0) = 1 AS is_pos FROM placed LEFT JOIN labels l USING (doc_id) WHERE len >= 150)"""
#: Each gene's largest score among windows that overlap it, by GC deviation of plain windows.
GENE_SCORES = f"""{GENES}, contigs AS (SELECT source AS contig_id, string_agg(seq, '' ORDER BY doc_id) AS seq FROM doc_seq GROUP BY source), {windows()}, {letters()},
gcs AS (SELECT w.contig_id, w.start, w."end", l.c + l.g AS gc FROM wins w JOIN letters_wins l USING (contig_id, window_no)),
dev AS (SELECT contig_id, start, "end", round(abs(gc - avg(gc) OVER (PARTITION BY contig_id)), 9) AS dev FROM gcs),
gene_scores AS (SELECT g.contig_id, g.gene_id, g.start, g."end", g.is_pos, coalesce(max(d.dev), 0.0) AS score FROM genes g LEFT JOIN dev d ON d.contig_id = g.contig_id AND d."end" > g.start AND d.start < g."end" GROUP BY ALL)"""
#: The same by the scan's composite, over all scored windows.
COMPOSITE_SCORES = f"""{SCAN.removeprefix("WITH ")}, {GENES.removeprefix(DOCS + ",").lstrip()},
gene_scores AS (SELECT g.contig_id, g.gene_id, g.start, g."end", g.is_pos, coalesce(max(round(d.composite, 9)), 0.0) AS score FROM genes g LEFT JOIN scored d ON d.contig_id = g.contig_id AND d."end" > g.start AND d.start < g."end" GROUP BY ALL)"""

K = 5


def normal_two_sided(z: str) -> str:
    """By the series of erf up to 4 and the continued fraction of erfc beyond: apart from the sums that Spark takes."""
    x = f"(abs({z}) / sqrt(2))"
    series = f"2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 90), lambda k: CASE WHEN {x} = 0 THEN 0 ELSE exp(2 * k * ln(2) + (2 * k + 1) * ln({x}) + lgamma(k + 1) - lgamma(2 * k + 2)) END))"
    fraction = f"list_reduce(list_transform(range(40, 0, -1), lambda k: CAST(k AS DOUBLE)), lambda a, k: {x} + k / 2 / a, 40 / {x})"
    return f"CASE WHEN {x} < 4 THEN greatest(1 - {series}, 0) ELSE exp(-{x} * {x}) / sqrt(pi()) / ({fraction}) END"


def student_two_sided(t: str, freedom: str) -> str:
    """By Simpson's rule over the angle, 2,000 steps, with the constant from gamma functions."""
    end = f"atan2(sqrt({freedom}), abs({t}))"
    f = f"list_sum(list_transform(range(0, 2001), lambda j: (CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * pow(sin({end} * j / 2000), {freedom} - 1)))"
    return f"{end} / 6000 * {f} * 2 * exp(lgamma(({freedom} + 1) / 2.0) - lgamma({freedom} / 2.0)) / sqrt(pi())"


def packed(letters: str, k: int) -> str:
    """A k-mer's letters as a number, base 4."""
    return f"CAST(list_reduce(list_transform(range(1, {k + 1}), lambda j: CAST(instr('ACGT', substr({letters}, j, 1)) - 1 AS BIGINT)), lambda a, b: a * 4 + b) AS BIGINT)"


def isolates(k: int, strong: float) -> str:
    return f"""{DOCS},
isolates AS (SELECT d.doc_id AS genome_id, CASE WHEN l.quality = 1 THEN 'R' ELSE 'S' END AS label, d.lang AS lineage, d.seq FROM doc_seq d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL),
strands AS (SELECT genome_id, label, lineage, seq FROM isolates UNION ALL SELECT genome_id, label, lineage, reverse(translate(seq, 'ACGT', 'TGCA')) FROM isolates),
gkmers AS (SELECT DISTINCT genome_id, label, lineage, {packed('g', k)} AS kmer
  FROM (SELECT genome_id, label, lineage, substr(seq, i, {k}) AS g FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS i FROM strands))),
sizes AS (SELECT count(*) FILTER (WHERE label = 'R') AS n_r, count(*) FILTER (WHERE label = 'S') AS n_s FROM isolates),
assoc0 AS (SELECT kmer, count(*) FILTER (WHERE label = 'R') AS cnt_r, count(*) FILTER (WHERE label = 'S') AS cnt_s FROM gkmers GROUP BY kmer),
assoc AS (SELECT kmer, cnt_r, cnt_s, cnt_r / n_r - cnt_s / n_s AS score FROM assoc0, sizes WHERE cnt_r + cnt_s BETWEEN 3 AND n_r + n_s - 1),
strong AS (SELECT kmer FROM assoc WHERE round(score, 9) >= {strong}),
doc_hits AS (SELECT genome_id, i - 1 AS pos FROM (SELECT genome_id, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM isolates)
  WHERE {packed(f'substr(seq, i, {k})', k)} IN (SELECT kmer FROM strong))"""


ISOLATES = isolates(K, 0.35)
