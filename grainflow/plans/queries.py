"""The library's queries on the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import binning, physics
from ..functions.scalars import moment_mean
from ..functions.tables import materialize, scratch
from ..operators import cluster, fields, grid, gridding, morphology, profiles, select, smoothing, velocity
from ..operators.grid import Boundary
from ..sources import blocks as block_files
from ..sources import datasource
from . import views
from .network import Network, Options, changes, evolution
from .views import SUMS, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _r(x: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({x}, {digits}) AS {name or x}"


# ---------------------------------------------------------------- selection

BLOCKS = "b AS (SELECT DISTINCT day(ts)::INT AS step_index, day(ts) * 100.0::DOUBLE AS timestep FROM events)"
LOG = "l AS (SELECT day(ts)::INT AS row_id, day(ts) * 100.0::DOUBLE + 7 AS step, round(sum(sum(value)) OVER (ORDER BY day(ts)), 2) AS time FROM events GROUP BY day(ts))"


@query(f"""WITH {BLOCKS}, q AS (SELECT event_id, value * 30 AS request FROM events)
SELECT event_id, round(request, 6) AS request, step_index, timestep FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(timestep - request), step_index) AS k FROM q CROSS JOIN b) WHERE k = 1""")
def step_nearest_timestep(spark, d):
    q = views.table(spark, d, "events").select("event_id", (F.col("value") * 30).alias("request"))
    return rounded(select.by_timestep(q, views.blocks(spark, d)))


@query(f"""WITH {BLOCKS}, {LOG}, q AS (SELECT event_id, value * (SELECT max(time) FROM l) / 100 AS request FROM events),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(time - request), row_id) AS k FROM q CROSS JOIN l) WHERE k = 1)
SELECT event_id, {_r("request")}, step, time, step_index, timestep FROM (SELECT n.*, b.*, row_number() OVER (PARTITION BY event_id ORDER BY abs(timestep - step), step_index) AS j FROM n CROSS JOIN b) WHERE j = 1""")
def step_nearest_time(spark, d):
    log = views.log(spark, d)
    top = log.agg(F.max("time")).first()[0]
    q = views.table(spark, d, "events").select("event_id", (F.col("value") * F.lit(top) / 100).alias("request"))
    return rounded(select.by_time(q, log, views.blocks(spark, d)))


@query(f"WITH {BLOCKS}, {LOG} SELECT step_index, timestep, time FROM (SELECT *, row_number() OVER (PARTITION BY step_index ORDER BY abs(step - timestep), row_id) AS k FROM b CROSS JOIN l) WHERE k = 1")
def block_times(spark, d):
    return select.times_of(views.blocks(spark, d), views.log(spark, d))


@query(f"WITH {BLOCKS} SELECT step_index, timestep FROM (SELECT *, row_number() OVER (ORDER BY step_index) AS k FROM b WHERE timestep BETWEEN 300 AND 2500) WHERE (k - 1) % 4 = 0")
def step_range_stride(spark, d):
    return select.in_range(views.blocks(spark, d), "timestep", (300, 2500), 4)


@query("""WITH g AS (SELECT user_id, hour(ts)::INT AS h, count(*) FILTER (event_type = 'purchase') AS n, sum(value) AS s, count(*)::DOUBLE AS k FROM events GROUP BY ALL)
SELECT user_id, h::DOUBLE AS "Coord1", n::DOUBLE AS "Ncount", CASE WHEN n <> 0 THEN round(s, 4) END AS total, CASE WHEN n <> 0 THEN k END AS k FROM g""")
def empty_cell_mask(spark, d):
    e = views.table(spark, d, "events").groupBy(F.col("user_id").alias("Coord0"), F.hour("ts").cast("double").alias("Coord1"))
    g = e.agg(F.count_if(F.col("event_type") == "purchase").cast("double").alias("Ncount"), F.sum("value").alias("total"), F.count("*").cast("double").alias("k"))
    return rounded(block_files.mask_empty(g), 4).withColumnRenamed("Coord0", "user_id")


# ---------------------------------------------------------------- fields

_SUMS = ", ".join(f"sum({x}) AS {c}" for c, x in SUMS.items())
_PHYS = f"p AS (SELECT l_quantity AS x, l_linenumber::DOUBLE AS y, count(*)::DOUBLE AS n, {_SUMS} FROM lineitem GROUP BY ALL)"
_U = physics.Units()
_DV = 0.25
_V = ", ".join(f"v_mv{a} / nullif(v_mass, 0) AS v{a}" for a in "xyz")


def _stress(a: str, k: int) -> str:
    i, j = a
    kinetic = f"{_U.mvv2e} * {_U.nktv2p} * (v_mvv{a} + v_mass * v{i} * v{j} - v{i} * v_mv{j} - v{j} * v_mv{i})"
    return f"(c_virial_{k}_ - {kinetic}) / {_DV} * {_U.bar2gpa} AS s{a}"


_STRESS = ", ".join(_stress(a, k) for k, a in enumerate(physics.STRESSES, 1))
_FIELDS = f"""{_PHYS}, w AS (SELECT *, {_V} FROM p), f AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS speed, v_mass / {_DV} * {_U.mass2gcm3} AS density,
2 * (c_ke + 0.5 * {_U.mvv2e} * v_mass * (vx * vx + vy * vy + vz * vz) - {_U.mvv2e} * (vx * v_mvx + vy * v_mvy + vz * v_mvz)) / nullif(3 * n * {_U.kb}, 0) AS t, {_STRESS} FROM w)"""


def _field(name: str, sql: str, digits: int = 6) -> None:
    def run(spark, d):
        return rounded(fields.field(views.phys(spark, d), name, "2d", dv=_DV).drop("step_index"), digits)

    run.__name__ = f"field_{name.lower()}"
    query(f"WITH {_FIELDS} SELECT x, y, {_r(sql, 'value', digits)} FROM f")(run)


for _name, _sql in {
    "vx": "vx", "vy": "vy", "vz": "vz", "velocity": "speed", "t": "t", "density": "density", "pressure": "-(sxx + syy + szz) / 3", **{f"s{a}": f"s{a}" for a in physics.STRESSES},
    "vonMisesS": "sqrt(0.5 * ((sxx - syy) ** 2 + (syy - szz) ** 2 + (szz - sxx) ** 2 + 6 * (sxy ** 2 + sxz ** 2 + syz ** 2)))",
}.items():
    _field(_name, _sql, 4)


@query(f"WITH {_FIELDS} SELECT x * 2 AS x, y * 2 AS y, {_r('density', 'value', 4)} FROM f WHERE x * 2 BETWEEN 10 AND 60 AND y * 2 BETWEEN 4 AND 10")
def field_range(spark, d):
    return rounded(fields.field(views.phys(spark, d), "density", "2d", dv=_DV, scale=2.0, range_x=(10, 60), range_y=(4, 10)).drop("step_index"), 4)


_TABLE = ["vx", "vy", "vz", "speed", "density AS density_gcm3", "t AS T", "-(sxx + syy + szz) / 3 AS pressure", *(f"s{a} AS sigma_{a}" for a in physics.STRESSES)]


@query(f"WITH {_FIELDS} SELECT x AS Coord1, y AS Coord2, {', '.join(_r(c.split(' AS ')[0], c.split(' AS ')[-1], 4) for c in _TABLE)} FROM f")
def derived_table(spark, d):
    return rounded(physics.derived_table(views.phys(spark, d), _DV, ("Coord1", "Coord2")), 4)


# ---------------------------------------------------------------- clusters

_CL = "c AS (SELECT l_partkey AS row_id, count(*)::DOUBLE AS n, avg(l_quantity) AS c_x, avg(l_discount) AS c_y, avg(l_tax) AS vx, 2 * sqrt(count(*)::DOUBLE * 0.25 / pi()) AS d FROM lineitem GROUP BY ALL)"
_O = cluster.Options(dx=0.5)


def _clusters(spark, d, o=_O):
    return cluster.diameters(views.clusters(spark, d), o)


@query(f"WITH {_CL} SELECT row_id, n AS \"Ncount\", {_r('d', 'diameter')} FROM c")
def cluster_diameter(spark, d):
    return rounded(_clusters(spark, d).select("row_id", "Ncount", "diameter"))


@query("SELECT l_partkey AS row_id, round(2 * (3 * count(*) * 0.125 / (4 * pi())) ** (1.0 / 3.0), 6) AS diameter FROM lineitem GROUP BY ALL")
def cluster_diameter_3d(spark, d):
    return rounded(_clusters(spark, d, cluster.Options(dx=0.5, dim=3)).select("row_id", "diameter"))


@query(f"WITH {_CL} SELECT row_id, {_r('d', 'diameter')} FROM c WHERE c_x BETWEEN 22.25 AND 28.25 AND vx BETWEEN 0.03 AND 0.05 AND d BETWEEN 2.5 AND 3.4")
def cluster_range(spark, d):
    return rounded(_clusters(spark, d, cluster.Options(dx=0.5, ranges={"c_x": (28.25, 22.25), "vx": (0.03, 0.05), "c_z": (0, 1)}, diameter_range=(2.5, 3.4))).select("row_id", "diameter"))


_BASIC = "count({x}) AS n, round(min({x}), 6) AS min, round(max({x}), 6) AS max, round({mean}, 6) AS mean, round(CASE WHEN count({x}) = 1 THEN 0 ELSE stddev_samp({x}) END, 6) AS std, round(median({x}), 6) AS median"


@query(f"WITH {_CL} SELECT 1 AS step_index, {_BASIC.format(x='d', mean='avg(d)')} FROM c")
def cluster_stats(spark, d):
    return rounded(cluster.stats(_clusters(spark, d)))


@query(f"WITH {_CL} SELECT 1 AS step_index, round(sum(d ** 3) / sum(d ** 2), 6) AS mean FROM c")
def cluster_moment_mean(spark, d):
    return rounded(_clusters(spark, d).groupBy("step_index").agg(moment_mean(F.col("diameter"), 3, 2).alias("mean")))


@query(f"WITH {_CL} SELECT 1 AS step_index, {_BASIC.format(x='d', mean='avg(d)')}, " + ", ".join(f"round(quantile_cont(d, {q}), 6) AS q{round(q * 100):02d}" for q in cluster.QUANTILES) + " FROM c")
def quantiles(spark, d):
    return rounded(cluster.summary(_clusters(spark, d), ["step_index"], "diameter"))


@query(f"WITH {_CL} SELECT 1 AS step_index, round(avg(ln(d)), 6) AS mu, round(stddev_samp(ln(d)), 6) AS sigma, round(avg(d) ** 2 / nullif(var_samp(d), 0), 4) AS gamma_n, round(avg(d), 6) AS mean FROM c")
def cluster_fits(spark, d):
    f = cluster.fits(_clusters(spark, d))
    return rounded(f.withColumn("gamma_n", F.round("gamma_n", 4)))


_COUNT_EDGES = "SELECT i, CASE WHEN i = {n} THEN hi ELSE lo + i * (hi - lo) / {n} END AS e FROM (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {t}), range({n} + 1) r(i)"


def _bins_sql(edges: str, x: str, t: str, agg: str) -> str:
    """Bins of edges (i, e) with aggregates of the rows in each; the last bin is closed above."""
    return f"""eg AS ({edges}), bn AS (SELECT a.i + 1 AS bin_id, a.e AS edge_lo, b.e AS edge_hi, (a.e + b.e) / 2 AS center, b.i = (SELECT max(i) FROM eg) AS is_last FROM eg a JOIN eg b ON b.i = a.i + 1),
bx AS (SELECT bin_id, {agg} FROM bn JOIN {t} ON {x} >= edge_lo AND ({x} < edge_hi OR is_last AND {x} <= edge_hi) GROUP BY bin_id)"""


_HIST = """SELECT 1 AS step_index, bin_id::INT AS bin_id, round(edge_lo, 6) AS edge_lo, round(edge_hi, 6) AS edge_hi, round(center, 6) AS center, coalesce(k, 0) AS count,
round(coalesce(k, 0) / sum(coalesce(k, 0)) OVER (), 6) AS probability, round(coalesce(k, 0) / (sum(coalesce(k, 0)) OVER () * (edge_hi - edge_lo)), 6) AS pdf, (sum(coalesce(k, 0)) OVER (ORDER BY bin_id))::BIGINT AS cum_count FROM bn LEFT JOIN bx USING (bin_id)"""


@query(f"WITH {_CL}, {_bins_sql(_COUNT_EDGES.format(n=30, x='d', t='c'), 'd', 'c', 'count(*) AS k')} {_HIST}")
def cluster_hist_nbins(spark, d):
    return rounded(cluster.histogram(_clusters(spark, d), ["step_index"], bins=30))


#: Edges from the least value on while they don't pass the greatest, and one more if the last stays below it.
_WIDTH = "SELECT i, e FROM (SELECT i, lo + i * 0.1 AS e, hi, max(CASE WHEN lo + i * 0.1 <= hi THEN i END) OVER () AS n, max(CASE WHEN lo + i * 0.1 <= hi THEN lo + i * 0.1 END) OVER () AS last FROM (SELECT min(d) AS lo, max(d) AS hi FROM c), range(100000) r(i)) WHERE i <= n OR i = n + 1 AND last < hi - 4.5e-16 * hi"


@query(f"WITH {_CL}, {_bins_sql(_WIDTH, 'd', 'c', 'count(*) AS k')} {_HIST}")
def cluster_hist_binsize(spark, d):
    return rounded(cluster.histogram(_clusters(spark, d), ["step_index"], size=0.1))


@query(f"WITH {_CL}, {_bins_sql(_COUNT_EDGES.format(n=20, x='c_x', t='c'), 'c_x', 'c', 'avg(d) AS m, count(*) AS k')} SELECT 1 AS step_index, bin_id::INT AS bin_id, {_r('edge_lo')}, {_r('edge_hi')}, {_r('center')}, {_r('m', 'mean')}, coalesce(k, 0) AS count FROM bn LEFT JOIN bx USING (bin_id)")
def cluster_binned_mean(spark, d):
    return rounded(cluster.binned_mean(_clusters(spark, d), "c_x", 20))


@query(f"WITH {_CL}, k AS (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS t FROM c) SELECT 1 AS step_index, round(d, 6) AS x, r AS rank, round(r / t, 6) AS cdf, t - r + 1 AS rank_down, round((t - r + 1) / t, 6) AS cdf_down FROM k")
def cluster_cdf(spark, d):
    return rounded(cluster.cdf(_clusters(spark, d), ["step_index"]))


@query(f"""WITH {_CL}, s AS (SELECT min(d) AS lo, max(d) AS hi, avg(ln(d)) AS mu, stddev_samp(ln(d)) AS sg, avg(d) AS m, avg(d) ** 2 / var_samp(d) AS g FROM c),
q AS (SELECT i, lo + i * (hi - lo) / 299 AS x, s.* FROM s, range(300) r(i))
SELECT 1 AS step_index, i::INT AS i, {_r('x')}, round(exp(-0.5 * power((ln(x) - mu) / sg, 2)) / (x * sg * sqrt(2 * pi())), 5) AS lognormal, round(exp(g * ln(g) - lgamma(g) + (g - 1) * ln(x / m) - g * x / m - ln(m)), 5) AS gamma FROM q""")
def cluster_fit_curves(spark, d):
    c = cluster.fit_curves(_clusters(spark, d))
    return c.select("step_index", "i", F.round("x", 6).alias("x"), F.round("lognormal", 5).alias("lognormal"), F.round("gamma", 5).alias("gamma"))


# ---------------------------------------------------------------- velocity

_VX = "g AS (SELECT l_quantity AS q, sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) AS m1, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE 0 END) AS m2 FROM lineitem GROUP BY ALL)"
_DOWN = "OVER (ORDER BY q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(f"WITH {_VX} SELECT 1 AS step_index, (-q)::INT AS row_id, round(q * 0.001, 6) AS v, round(sum(m1) {_DOWN}, 2) AS \"mass1ArealDensity\", round(sum(m2) {_DOWN}, 2) AS \"mass2ArealDensity\", round(sum(m1 + m2) {_DOWN}, 2) AS \"massArealDensity\" FROM g")
def vx_cumulative(spark, d):
    c = velocity.cumulative(views.vxbins(spark, d))
    return c.select("step_index", "row_id", F.round("v", 6).alias("v"), *(F.round(x, 2).alias(x) for x in c.columns[3:]))


@query("SELECT 1 AS step_index, 'mass1ArealDensity,mass2ArealDensity,massArealDensity' AS plotted FROM lineitem GROUP BY 1 HAVING sum(l_extendedprice) FILTER (l_linestatus = 'O') > 0 AND sum(l_extendedprice) FILTER (l_linestatus = 'F') > 0")
def vx_plotted(spark, d):
    c = velocity.cumulative(views.vxbins(spark, d))
    return velocity.plotted(c, c.columns[3:]).select("step_index", F.concat_ws(",", "plotted").alias("plotted"))


# ---------------------------------------------------------------- grids

_RAW = {
    "cells": "c0 AS (SELECT 1 AS step_index, (day(ts) - 1)::DOUBLE AS x, hour(ts)::DOUBLE AS y, count(*)::DOUBLE AS ncount, sum(value) AS v FROM events GROUP BY ALL)",
    "cells_step": "c0 AS (SELECT ((day(ts) - 1) // 6 + 1)::INT AS step_index, hour(ts)::DOUBLE AS x, ((day(ts) - 1) % 6)::DOUBLE AS y, count(*)::DOUBLE AS ncount, sum(value) AS v FROM events GROUP BY ALL)",
    "order_lines": "c0 AS (SELECT (l_orderkey // 32)::INT AS step_index, l_orderkey::DOUBLE AS x, l_linenumber::DOUBLE AS y, sum(l_quantity)::DOUBLE AS ncount, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL)",
}


def _cells(view: str = "cells", threshold: str = "(SELECT median(ncount) FROM c0)") -> str:
    return f"""{_RAW[view]}, c1 AS (SELECT *, (dense_rank() OVER (PARTITION BY step_index ORDER BY x) - 1)::INT AS ix, (dense_rank() OVER (PARTITION BY step_index ORDER BY y) - 1)::INT AS iy,
CASE WHEN ncount < {threshold} THEN 'pore' ELSE 'matrix' END AS phase FROM c0), c AS (SELECT *, max(ix) OVER (PARTITION BY step_index) + 1 AS nx, max(iy) OVER (PARTITION BY step_index) + 1 AS ny, ix * 10000 + iy AS k FROM c1)"""


def _edges(px: bool, py: bool) -> str:
    right = "(a.ix + 1) % a.nx" if px else "a.ix + 1"
    up = "(a.iy + 1) % a.ny" if py else "a.iy + 1"
    col = "a.step_index, a.k AS u, b.k AS v, a.phase AS p, b.phase AS q, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my"
    return f"""e AS (SELECT {col}, 'x' AS dir, 1.0 AS len, CASE WHEN a.ix + 1 = a.nx THEN 1 ELSE 0 END AS ox, 0 AS oy FROM c a JOIN c b ON a.step_index = b.step_index AND b.ix = {right} AND b.iy = a.iy
UNION ALL SELECT {col}, 'y', 1.0, 0, CASE WHEN a.iy + 1 = a.ny THEN 1 ELSE 0 END FROM c a JOIN c b ON a.step_index = b.step_index AND b.iy = {up} AND b.ix = a.ix)"""


#: Components by reachability: each cell with the least cell that it reaches. Needs WITH RECURSIVE.
_COMP = """s AS (SELECT step_index, u, v FROM e WHERE p = q UNION SELECT step_index, v, u FROM e WHERE p = q),
reach(step_index, k, root) AS (SELECT step_index, k, k FROM c UNION SELECT r.step_index, s.v, r.root FROM reach r JOIN s ON s.step_index = r.step_index AND s.u = r.k),
m AS (SELECT step_index, k, min(root) AS comp FROM reach GROUP BY ALL),
lab AS (SELECT c.*, comp, dense_rank() OVER (PARTITION BY c.step_index, phase ORDER BY comp) AS label FROM c JOIN m USING (step_index, k))"""

_STATS = """open_ AS (SELECT step_index, comp, 4.0 * count(*) AS sides FROM lab GROUP BY ALL), inner_ AS (SELECT e.step_index, l.comp, sum(2 * len) AS cut FROM e JOIN lab l ON l.step_index = e.step_index AND l.k = e.u WHERE p = q GROUP BY ALL),
face AS (SELECT step_index, comp, sum(len) AS face FROM (SELECT e.step_index, l.comp, len FROM e JOIN lab l ON l.step_index = e.step_index AND l.k = e.u WHERE p <> q UNION ALL SELECT e.step_index, l.comp, len FROM e JOIN lab l ON l.step_index = e.step_index AND l.k = e.v WHERE p <> q) GROUP BY ALL),
cs AS (SELECT lab.step_index, phase, comp, label, count(*) AS cell_count, count(*)::DOUBLE AS area, 2 * sqrt(count(*) / pi()) AS equiv_diameter, avg(x) AS centroid_x, avg(y) AS centroid_y, (max(ix) - min(ix) + 1)::DOUBLE AS bbox_width, (max(iy) - min(iy) + 1)::DOUBLE AS bbox_height,
bool_or(ix = 0) AS touches_left, bool_or(ix = nx - 1) AS touches_right, bool_or(iy = 0) AS touches_bottom, bool_or(iy = ny - 1) AS touches_top FROM lab GROUP BY ALL),
comps AS (SELECT cs.*, sides - coalesce(cut, 0) AS perimeter_open, coalesce(face, 0) AS interface_perimeter, touches_left AND touches_right AS percolates_x, touches_bottom AND touches_top AS percolates_y, row_number() OVER (PARTITION BY step_index, phase ORDER BY area DESC, label) AS size_rank
FROM cs JOIN open_ USING (step_index, comp) LEFT JOIN inner_ USING (step_index, comp) LEFT JOIN face USING (step_index, comp))"""

#: Whether components wrap: from their first cells, reachability with the number of seams crossed, up to one each way.
_WRAP = """t AS (SELECT step_index, u, v, ox, oy FROM e WHERE p = q UNION SELECT step_index, v, u, -ox, -oy FROM e WHERE p = q),
walk(step_index, root, k, ox, oy) AS (SELECT step_index, comp, comp, 0, 0 FROM (SELECT DISTINCT step_index, comp FROM m) UNION SELECT w.step_index, w.root, t.v, w.ox + t.ox, w.oy + t.oy FROM walk w JOIN t ON t.step_index = w.step_index AND t.u = w.k WHERE abs(w.ox + t.ox) <= 1 AND abs(w.oy + t.oy) <= 1),
wrap AS (SELECT step_index, root AS comp, bool_or(k = root AND ox <> 0) AS wrap_x, bool_or(k = root AND oy <> 0) AS wrap_y FROM walk GROUP BY ALL)"""


def _net(spark, d, view: str = "cells", boundary: str = "open", factor: float = 1.0, **more) -> Network:
    df = materialize(getattr(views, view)(spark, d).select("step_index", "x", "y", "ncount"), "view")  # read for the threshold, both axes and the cells
    return Network(df, Options(views.threshold(df) * factor, boundary, **more))


def _global_sql(view: str, px: bool, py: bool) -> str:
    return f"""WITH {_cells(view)}, {_edges(px, py)}, n AS (SELECT step_index, count(*) AS valid_cells, count(*) FILTER (phase = 'pore') AS pore_cells FROM c GROUP BY ALL), i AS (SELECT step_index, sum(len) AS l FROM e WHERE p <> q GROUP BY ALL)
SELECT step_index, valid_cells, pore_cells, coalesce(l, 0)::DOUBLE AS interface_length, valid_cells - pore_cells AS matrix_cells, valid_cells::DOUBLE AS valid_area, pore_cells::DOUBLE AS pore_area, (valid_cells - pore_cells)::DOUBLE AS matrix_area,
round(pore_cells / valid_cells, 6) AS porosity, round((valid_cells - pore_cells) / valid_cells, 6) AS matrix_fraction, round(coalesce(l, 0) / valid_cells, 6) AS specific_interface, round(coalesce(l, 0) / nullif(pore_cells, 0), 6) AS specific_interface_pore, round(coalesce(l, 0) / nullif(valid_cells - pore_cells, 0), 6) AS specific_interface_matrix
FROM n LEFT JOIN i USING (step_index)"""


@query(_global_sql("cells_step", False, False))
def phase_global(spark, d):
    return rounded(_net(spark, d, "cells_step").globals)


@query(_global_sql("cells", True, True))
def phase_global_periodic(spark, d):
    return rounded(_net(spark, d, "cells", "periodic-xy").globals)


@query(f"WITH RECURSIVE {_cells()}, {_edges(False, False)}, {_COMP} SELECT step_index, ix, iy, phase, label::INT AS label FROM lab")
def components(spark, d):
    net = _net(spark, d, tile=7)
    return grid.labelled(net.cells, net.b, net.o.tile)


_COMPONENT_COLUMNS = "step_index, phase, label::INT AS label, cell_count, area, round(equiv_diameter, 6) AS equiv_diameter, round(centroid_x, 6) AS centroid_x, round(centroid_y, 6) AS centroid_y, bbox_width, bbox_height, perimeter_open::DOUBLE AS perimeter_open, interface_perimeter::DOUBLE AS interface_perimeter, round(4 * pi() * area / nullif(perimeter_open, 0) ** 2, 6) AS shape_factor, touches_left, touches_right, touches_bottom, touches_top, percolates_x, percolates_y, size_rank::INT AS size_rank"


@query(f"WITH RECURSIVE {_cells('cells_step')}, {_edges(False, False)}, {_COMP}, {_STATS} SELECT {_COMPONENT_COLUMNS} FROM comps")
def component_stats(spark, d):
    return rounded(_net(spark, d, "cells_step", tile=5).components.drop("component", "wrap_x", "wrap_y"))


@query(f"WITH RECURSIVE {_cells(threshold='1.15 * (SELECT median(ncount) FROM c0)')}, {_edges(True, True)}, {_COMP}, {_WRAP} SELECT step_index, phase, label::INT AS label, count(*) AS cell_count, wrap_x, wrap_y FROM lab JOIN wrap USING (step_index, comp) WHERE phase = 'pore' GROUP BY ALL")
def connectivity_periodic(spark, d):
    return _net(spark, d, boundary="periodic-xy", factor=1.15, tile=9).components.where("phase = 'pore'").select("step_index", "phase", "label", "cell_count", "wrap_x", "wrap_y")


@query(f"WITH RECURSIVE {_cells('cells_step')}, {_edges(False, False)}, {_COMP}, {_STATS} SELECT step_index, ix, iy, CASE WHEN lab.phase = 'pore' THEN size_rank ELSE 0 END::INT AS rank FROM lab JOIN (SELECT step_index, comp, size_rank FROM comps) USING (step_index, comp)")
def size_rank(spark, d):
    net = _net(spark, d, "cells_step")
    return grid.size_rank_grid(net.cells, net.b, net.components)


@query(f"WITH RECURSIVE {_cells('cells_step')}, {_edges(False, False)}, {_COMP}, {_STATS} SELECT step_index, ix, iy, CASE WHEN lab.phase <> 'pore' THEN 0 WHEN percolates_y THEN 2 ELSE 1 END::INT AS class FROM lab JOIN (SELECT step_index, comp, percolates_y FROM comps) USING (step_index, comp)")
def connectivity_classes(spark, d):
    net = _net(spark, d, "cells_step")
    return grid.connectivity_grid(net.cells, net.b, net.components, "y")


def _topology_sql(view: str, px: bool, py: bool) -> str:
    right, up = ("(a.ix + 1) % a.nx" if px else "a.ix + 1"), ("(a.iy + 1) % a.ny" if py else "a.iy + 1")
    square = " ".join(f"JOIN c {t} ON {t}.step_index = a.step_index AND {t}.phase = a.phase AND {t}.ix = {x} AND {t}.iy = {y}" for t, x, y in (("r", right, "a.iy"), ("w", "a.ix", up), ("z", right, up)))
    beta2 = "CASE WHEN n0 = nx * ny THEN 1 ELSE 0 END" if px and py else "0"
    return f"""WITH RECURSIVE {_cells(view)}, {_edges(px, py)}, {_COMP}, both_ AS (SELECT step_index, phase, max(nx) AS nx, max(ny) AS ny FROM (SELECT DISTINCT step_index, nx, ny FROM c), (VALUES ('pore'), ('matrix')) v(phase) GROUP BY ALL),
t0 AS (SELECT step_index, phase, count(*) AS n0, count(DISTINCT comp) AS beta0 FROM lab GROUP BY ALL), t1 AS (SELECT step_index, p AS phase, count(*) AS n1 FROM e WHERE p = q GROUP BY ALL), t2 AS (SELECT a.step_index, a.phase, count(*) AS n2 FROM c a {square} GROUP BY ALL),
f AS (SELECT step_index, phase, coalesce(beta0, 0) AS beta0, {beta2} AS beta2, coalesce(n0 - coalesce(n1, 0) + coalesce(n2, 0), 0) AS chi, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2 FROM both_ LEFT JOIN t0 USING (step_index, phase) LEFT JOIN t1 USING (step_index, phase) LEFT JOIN t2 USING (step_index, phase))
SELECT step_index, phase, beta0, greatest(0, beta0 + beta2 - chi)::BIGINT AS beta1, beta2::INT AS beta2, chi, n0, n1, n2 FROM f"""


@query(_topology_sql("cells", False, False))
def topology_open(spark, d):
    return _net(spark, d).topology.drop("note")


@query(_topology_sql("cells", True, True))
def topology_periodic_xy(spark, d):
    return _net(spark, d, boundary="periodic-xy").topology.drop("note")


@query(_topology_sql("cells_step", True, False))
def topology_periodic_x(spark, d):
    return _net(spark, d, "cells_step", "periodic-x").topology.drop("note")


@query(f"""WITH RECURSIVE {_cells('cells_step')}, {_edges(False, False)}, {_COMP}, {_STATS}, h AS (SELECT step_index, phase, axis, label, area, CASE WHEN axis = 'x' THEN percolates_x ELSE percolates_y END AS hit FROM comps, (VALUES ('x'), ('y')) a(axis))
SELECT step_index, phase, axis, count(*) FILTER (hit) AS component_count, coalesce(string_agg(label::VARCHAR, ',' ORDER BY label) FILTER (hit), '') AS component_ids, coalesce(sum(area) FILTER (hit), 0)::DOUBLE AS connected_area, coalesce(max(area) FILTER (hit), 0)::DOUBLE AS largest_connected_area, round(coalesce(sum(area) FILTER (hit), 0) / sum(area), 6) AS connected_fraction, bool_or(hit) AS is_connected, bool_or(hit) AS percolates, false AS wraps FROM h GROUP BY ALL""")
def connectivity_open(spark, d):
    net = _net(spark, d, "cells_step")
    ids = net.connected.groupBy("step_index", "phase", "axis").agg(F.array_join(F.transform(F.array_sort(F.collect_list("label")), lambda x: x.cast("string")), ",").alias("component_ids"))
    out = rounded(net.connectivity).join(ids, ["step_index", "phase", "axis"], "left")
    return out.withColumn("component_ids", F.coalesce("component_ids", F.lit("")))


@query(f"""WITH RECURSIVE {_cells('cells_step')}, {_edges(False, False)}, {_COMP}, {_STATS} SELECT step_index, phase, count(*) AS component_count, sum(area) AS phase_area, max(area) AS largest_area, round(max(equiv_diameter), 6) AS max_diameter, round(avg(equiv_diameter), 6) AS mean_diameter,
round(sum(equiv_diameter * area) / sum(area), 6) AS area_weighted_diameter, sum(perimeter_open)::DOUBLE AS perimeter_open, sum(interface_perimeter)::DOUBLE AS interface_perimeter, round(max(area) / sum(area), 6) AS largest_fraction FROM comps GROUP BY ALL""")
def phase_sizes(spark, d):
    return rounded(_net(spark, d, "cells_step").sizes)


@query(f"WITH RECURSIVE {_cells('cells_step')}, {_edges(False, False)}, {_COMP}, {_STATS} SELECT step_index, phase, {_BASIC.format(x='area', mean='avg(area)')}, " + ", ".join(f"round(quantile_cont(area, {q}), 6) AS q{round(q * 100):02d}" for q in cluster.QUANTILES) + " FROM comps GROUP BY ALL")
def phase_summary(spark, d):
    return rounded(_net(spark, d, "cells_step").summary("area"))


@query(f"""WITH RECURSIVE {_cells()}, {_edges(False, False)}, {_COMP}, {_STATS}, lim AS (SELECT phase, min(equiv_diameter) AS lo, max(equiv_diameter) AS hi FROM comps GROUP BY ALL),
lim2 AS (SELECT phase, CASE WHEN lo = hi THEN lo - greatest(1e-12, abs(lo) * 1e-6) ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + greatest(1e-12, abs(hi) * 1e-6) ELSE hi END AS hi FROM lim),
eg AS (SELECT phase, i, CASE WHEN i = 30 THEN hi ELSE lo + i * (hi - lo) / 30 END AS e FROM lim2, range(31) r(i)), bn AS (SELECT a.phase, a.i + 1 AS bin_id, a.e AS edge_lo, b.e AS edge_hi, b.i = 30 AS is_last FROM eg a JOIN eg b ON b.i = a.i + 1 AND a.phase = b.phase),
bx AS (SELECT bn.phase, bin_id, count(*) AS k FROM bn JOIN comps ON bn.phase = comps.phase AND equiv_diameter >= edge_lo AND (equiv_diameter < edge_hi OR is_last AND equiv_diameter <= edge_hi) GROUP BY ALL)
SELECT 1 AS step_index, phase, bin_id::INT AS bin_id, round(edge_lo, 6) AS edge_lo, round(edge_hi, 6) AS edge_hi, round((edge_lo + edge_hi) / 2, 6) AS center, coalesce(k, 0) AS count, round(coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY phase), 6) AS probability,
round(coalesce(k, 0) / (sum(coalesce(k, 0)) OVER (PARTITION BY phase) * (edge_hi - edge_lo)), 4) AS pdf, (sum(coalesce(k, 0)) OVER (PARTITION BY phase ORDER BY bin_id))::BIGINT AS cum_count FROM bn LEFT JOIN bx USING (phase, bin_id)""")
def component_histogram(spark, d):
    h = _net(spark, d).histogram
    return rounded(h.withColumn("pdf", F.round("pdf", 4)))


# ---------------------------------------------------------------- profiles

_AXIS_EDGES = "SELECT i, CASE WHEN i = {n} THEN hi ELSE lo + i * (hi - lo) / {n} END AS e FROM (SELECT min({a}) - 0.5 AS lo, max({a}) + 0.5 AS hi FROM c), range({n} + 1) r(i)"
_IN = "{x} >= edge_lo AND ({x} < edge_hi OR is_last AND {x} <= edge_hi + 1e-9)"


def _profile_sql(axis: str, n: int) -> str:
    return f"""WITH {_cells()}, {_edges(False, False)}, {_bins_sql(_AXIS_EDGES.format(n=n, a=axis), axis, 'c', "count(*) AS v, count(*) FILTER (phase = 'pore') AS p")}, il AS (SELECT bin_id, sum(len) AS l FROM bn JOIN e ON {_IN.format(x='m' + axis)} WHERE p <> q GROUP BY ALL),
z AS (SELECT bn.*, coalesce(v, 0)::DOUBLE AS v, coalesce(p, 0)::DOUBLE AS p, coalesce(l, 0)::DOUBLE AS l FROM bn LEFT JOIN bx USING (bin_id) LEFT JOIN il USING (bin_id))
SELECT 1 AS step_index, bin_id::INT AS bin_id, {_r('edge_lo')}, {_r('edge_hi')}, {_r('center')}, l AS interface_length, v AS valid_area, p AS pore_area, v - p AS matrix_area, round(p / nullif(v, 0), 6) AS porosity, round(l / nullif(v, 0), 6) AS specific_interface, round(l / nullif(p, 0), 6) AS specific_interface_pore, round(l / nullif(v - p, 0), 6) AS specific_interface_matrix FROM z"""


@query(_profile_sql("x", 10))
def profile_x(spark, d):
    net = _net(spark, d)
    return rounded(profiles.porosity(net.cells, "x", 1.0, 1.0, 10))


@query(_profile_sql("y", 7))
def profile_y(spark, d):
    net = _net(spark, d)
    return rounded(profiles.porosity(net.cells, "y", 1.0, 1.0, 7))


@query(f"""WITH RECURSIVE {_cells()}, {_edges(False, False)}, {_COMP}, {_STATS}, {_bins_sql(_AXIS_EDGES.format(n=8, a='x'), 'x', 'c', 'count(*) AS v')}, k AS (SELECT bin_id, count(*) FILTER (percolates_y) AS n, coalesce(sum(area) FILTER (percolates_y), 0) AS a, sum(area) AS t FROM bn JOIN comps ON {_IN.format(x='centroid_x')} WHERE phase = 'pore' GROUP BY ALL)
SELECT 1 AS step_index, bin_id::INT AS bin_id, {_r('edge_lo')}, {_r('edge_hi')}, {_r('center')}, coalesce(n, 0) AS connected_count, coalesce(a, 0)::DOUBLE AS connected_area, coalesce(t, 0)::DOUBLE AS component_area, round(coalesce(a / nullif(t, 0), 0), 6) AS connected_fraction, coalesce(n, 0) > 0 AS is_connected FROM bn LEFT JOIN k USING (bin_id)""")
def profile_connectivity(spark, d):
    net = _net(spark, d)
    return rounded(profiles.connectivity(net.cells, net.components, net.b, "x", 1.0, 1.0, 8))


@query(f"""WITH RECURSIVE {_cells()}, {_edges(False, False)}, {_COMP}, {_STATS}, lim AS (SELECT phase, min(centroid_x) AS lo, max(centroid_x) AS hi FROM comps GROUP BY ALL), eg AS (SELECT phase, i, CASE WHEN lo = hi THEN lo - 0.5 + i WHEN i = 12 THEN hi ELSE lo + i * (hi - lo) / 12 END AS e FROM lim, range(13) r(i) WHERE lo < hi OR i < 2),
bn AS (SELECT a.phase, a.i + 1 AS bin_id, a.e AS edge_lo, b.e AS edge_hi, b.i = max(b.i) OVER (PARTITION BY a.phase) AS is_last FROM eg a JOIN eg b ON b.i = a.i + 1 AND a.phase = b.phase),
bx AS (SELECT bn.phase, bin_id, avg(equiv_diameter) AS m, count(*) AS k FROM bn JOIN comps ON bn.phase = comps.phase AND {_IN.format(x='centroid_x')} GROUP BY ALL)
SELECT 1 AS step_index, phase, bin_id::INT AS bin_id, {_r('edge_lo')}, {_r('edge_hi')}, round((edge_lo + edge_hi) / 2, 6) AS center, {_r('m', 'mean_diameter')}, coalesce(k, 0) AS count FROM bn LEFT JOIN bx USING (phase, bin_id)""")
def position_distribution(spark, d):
    return rounded(profiles.positions(_net(spark, d).components, "x", 1.0, 12))


# ---------------------------------------------------------------- evolution

def _series_sql(deltas: bool) -> str:
    sql = _topology_sql("cells_step", False, False).replace("SELECT step_index, phase, beta0, greatest", "SELECT step_index, phase, beta0, greatest")
    head, tail = sql.rsplit("\nSELECT ", 1)
    base = f"""{head}, tp AS (SELECT {tail}), {_STATS}, sz AS (SELECT step_index, phase, max(area) / sum(area) AS largest_fraction, avg(equiv_diameter) AS mean_diameter, max(equiv_diameter) AS max_diameter FROM comps GROUP BY ALL),
gl AS (SELECT step_index, count(*) FILTER (phase = 'pore') / count(*) AS porosity, count(*) AS n FROM c GROUP BY ALL), il AS (SELECT step_index, sum(len) AS l FROM e WHERE p <> q GROUP BY ALL)"""
    per = lambda p: ", ".join([*(f"max(tp.{c}) FILTER (tp.phase = '{p}') AS {p}_{c}" for c in ("beta0", "beta1", "chi")), *(f"round(coalesce(max(sz.{c}) FILTER (tp.phase = '{p}'), 0), 6) AS {p}_{c}" for c in ("largest_fraction", "mean_diameter", "max_diameter"))])
    rows = f"{base}, se AS (SELECT step_index, round(max(porosity), 6) AS porosity, coalesce(max(l), 0)::DOUBLE AS interface_length, round(coalesce(max(l), 0) / max(n), 6) AS specific_interface, {per('pore')}, {per('matrix')} FROM tp LEFT JOIN sz USING (step_index, phase) JOIN gl USING (step_index) LEFT JOIN il USING (step_index) GROUP BY step_index)"
    if not deltas:
        return f"{rows} SELECT * FROM se"
    lag = ", ".join(f"({c} - lag({c}) OVER (ORDER BY step_index))::DOUBLE AS d_{c}" for c in ("pore_beta0", "pore_beta1", "matrix_beta0"))
    return f"{rows} SELECT step_index, pore_beta0, pore_beta1, matrix_beta0, {lag} FROM se"


@query(_series_sql(False))
def evolution_series(spark, d):
    return rounded(_net(spark, d, "cells_step").series)


@query(_series_sql(True))
def evolution_deltas(spark, d):
    columns = ["pore_beta0", "pore_beta1", "matrix_beta0"]
    return changes(_net(spark, d, "cells_step").series.select("step_index", *columns), columns)


@query(_series_sql(True).replace(" FROM se", " FROM (SELECT * FROM se WHERE step_index % 2 = 1)").replace("SELECT step_index, pore_beta0, pore_beta1, matrix_beta0,", "SELECT step_index, step_index * 600.0::DOUBLE AS timestep, pore_beta0, pore_beta1, matrix_beta0,"))
def evolution_stride(spark, d):
    df = views.cells_step(spark, d)
    steps = df.select("step_index", (F.col("step_index") * 600.0).alias("timestep")).distinct()
    out = evolution(df, Options(views.threshold(df)), select.in_range(steps, "timestep", (0, 3000), 2))
    return out.select("step_index", "timestep", "pore_beta0", "pore_beta1", "matrix_beta0", "d_pore_beta0", "d_pore_beta1", "d_matrix_beta0")


# ---------------------------------------------------------------- smoothing and morphology

def _weights_sql(sigma: float) -> str:
    return "w AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in smoothing.weights(sigma)) + ") t(k, w))"


@query(f"""WITH {_RAW['cells']}, s AS (SELECT x AS key, y, CASE WHEN ncount >= (SELECT median(ncount) FROM c0) THEN v END AS v, row_number() OVER (PARTITION BY x ORDER BY y) AS r FROM c0), {_weights_sql(1.5)}
SELECT a.key, a.y, {_r('a.v', 'v', 4)}, CASE WHEN a.v IS NOT NULL THEN round(sum(b.v * w) / sum(CASE WHEN b.v IS NOT NULL THEN w END), 4) END AS smooth FROM s a JOIN w ON true LEFT JOIN s b ON b.key = a.key AND b.r = a.r + w.k GROUP BY a.key, a.y, a.v""")
def smooth_1d(spark, d):
    df = views.cells(spark, d)
    s = df.select(F.col("x").alias("key"), "y", F.when(F.col("ncount") >= views.threshold(df), F.col("v")).alias("v"))
    return rounded(smoothing.smooth_1d(s, "key", "y", "v", 1.5), 4)


@query(f"""WITH {_cells()}, s AS (SELECT step_index, ix, iy, CASE WHEN phase = 'matrix' THEN ncount END AS v FROM c), {_weights_sql(0.8)}
SELECT a.step_index, a.ix, a.iy, a.v, round(sum(b.v * p.w * q.w) / sum(CASE WHEN b.v IS NOT NULL THEN p.w * q.w END), 6) AS smooth FROM s a JOIN w p ON true JOIN w q ON true LEFT JOIN s b ON b.ix = a.ix + p.k AND b.iy = a.iy + q.k GROUP BY ALL""")
def smooth_2d(spark, d):
    cells = _net(spark, d).cells.select("step_index", "ix", "iy", F.when(F.col("phase") == "matrix", F.col("ncount")).alias("v"))
    return rounded(smoothing.smooth_2d(cells, "step_index", "ix", "iy", "v", 0.8, keep_null=False))


@query(f"""WITH {_RAW['cells']}, s AS (SELECT x AS key, y, CASE WHEN ncount >= (SELECT median(ncount) FROM c0) THEN v END AS v FROM c0), g AS (SELECT * FROM s WHERE v IS NOT NULL),
n AS (SELECT s.*, (SELECT list(struct_pack(x := g.y, v := g.v) ORDER BY g.y DESC) FROM g WHERE g.key = s.key AND g.y < s.y) AS b, (SELECT list(struct_pack(x := g.y, v := g.v) ORDER BY g.y) FROM g WHERE g.key = s.key AND g.y > s.y) AS a FROM s),
f AS (SELECT *, CASE WHEN b[1] IS NOT NULL AND a[1] IS NOT NULL THEN [b[1], a[1]] WHEN b[2] IS NOT NULL THEN [b[1], b[2]] WHEN a[2] IS NOT NULL THEN [a[1], a[2]] END AS pq FROM n)
SELECT key, y, {_r('v', digits=4)}, round(coalesce(v, pq[1].v + (y - pq[1].x) * (pq[2].v - pq[1].v) / (pq[2].x - pq[1].x)), 4) AS filled FROM f""")
def line_interp(spark, d):
    df = views.cells(spark, d)
    s = df.select(F.col("x").alias("key"), "y", F.when(F.col("ncount") >= views.threshold(df), F.col("v")).alias("v"))
    return rounded(smoothing.fill(s, "key", "y", "v"), 4)


@query("SELECT user_id AS key, hour(ts)::INT AS x, dayofweek(ts)::INT + 1 AS y, round(avg(CASE WHEN event_type <> 'view' THEN value END), 6) AS mean, count(CASE WHEN event_type <> 'view' THEN value END) AS n FROM events GROUP BY ALL")
def duplicate_mean(spark, d):
    e = views.table(spark, d, "events").select(F.col("user_id").alias("key"), F.hour("ts").alias("x"), F.dayofweek("ts").alias("y"), F.when(F.col("event_type") != "view", F.col("value")).alias("z"))
    return rounded(smoothing.duplicate_mean(e, "key", "x", "y", "z"))


@query(f"WITH {_RAW['cells_step']} SELECT step_index, min(ncount) - CASE WHEN min(ncount) = max(ncount) THEN greatest(1e-12, min(ncount) * 1e-6) ELSE 0 END AS lo, max(ncount) + CASE WHEN min(ncount) = max(ncount) THEN greatest(1e-12, min(ncount) * 1e-6) ELSE 0 END AS hi FROM c0 GROUP BY ALL")
def color_limits(spark, d):
    return smoothing.color_limits(views.cells_step(spark, d), "step_index", "ncount")


@query(f"""WITH {_cells()}, full_ AS (SELECT a.i::INT AS jx, b.i::INT AS jy FROM range((SELECT max(nx) FROM c)) a(i), range((SELECT max(ny) FROM c)) b(i)), bg AS (SELECT jx, jy FROM full_ LEFT JOIN c ON ix = jx AND iy = jy AND phase = 'matrix' WHERE k IS NULL)
SELECT step_index, ix, iy, round(sqrt(min((ix - jx) ** 2 + (iy - jy) ** 2)), 6) AS distance FROM c LEFT JOIN bg ON true WHERE phase = 'matrix' GROUP BY ALL""")
def phase_distance(spark, d):
    net = _net(spark, d)
    return rounded(morphology.distances(net.cells, net.b, "matrix"))


@query()
def skeleton(spark, d):
    return _net(spark, d).skeleton("matrix").select("step_index", "ix", "iy")


def _closed_sql(view: str) -> str:
    """Components of the matrix over eight neighbours, and its holes: what its skeleton must have too."""
    return f"""WITH RECURSIVE {_cells(view)}, m AS MATERIALIZED (SELECT step_index, ix, iy, ix * 100000 + iy AS a FROM c WHERE phase = 'matrix'),
nb AS MATERIALIZED (SELECT m.step_index, m.a, n.a AS b FROM m JOIN (VALUES (-1), (0), (1)) i(i) ON true JOIN (VALUES (-1), (0), (1)) j(j) ON true JOIN m n ON n.step_index = m.step_index AND n.ix = m.ix + i AND n.iy = m.iy + j),
r AS (SELECT step_index, a, a AS root FROM m UNION SELECT r.step_index, nb.b, r.root FROM r JOIN nb USING (step_index, a)), k AS (SELECT step_index, count(DISTINCT root) AS components FROM (SELECT step_index, a, min(root) AS root FROM r GROUP BY ALL) GROUP BY ALL),
v AS (SELECT step_index, count(DISTINCT (ix + i, iy + j)) AS corners FROM m, range(2) i(i), range(2) j(j) GROUP BY ALL), e AS (SELECT step_index, count(DISTINCT (i, ix + i * o, iy + (1 - i) * o)) AS sides FROM m, range(2) i(i), range(2) o(o) GROUP BY ALL), n AS (SELECT step_index, count(*) AS n FROM m GROUP BY ALL)
SELECT step_index, components, components - n + sides - corners AS holes FROM k JOIN v USING (step_index) JOIN e USING (step_index) JOIN n USING (step_index)"""


def _skeleton_topology(spark, d, view):
    net = _net(spark, d, view)
    return morphology.closed_topology(net.skeleton("matrix"), net.b).drop("cells")


@query(_closed_sql("cells_step"))
def skeleton_topology(spark, d):
    return _skeleton_topology(spark, d, "cells_step")


@query(_closed_sql("order_lines"))
def order_skeleton_topology(spark, d):
    return _skeleton_topology(spark, d, "order_lines")


@query()
def skeleton_stats(spark, d):
    return rounded(_net(spark, d, "cells_step").skeleton_stats("matrix"))


@query()
def thickness(spark, d):
    return rounded(_net(spark, d, "cells_step").thickness)


@query()
def network_stats(spark, d):
    return _net(spark, d, "cells_step").stats.select("step_index", F.to_json(F.struct("meta", "topology", "connectivity", "geometry", "size", "thickness", "network")).alias("stats"))


@query("SELECT (l_quantity::INT % 5)::INT AS key, round(min(l_extendedprice), 6) AS lo, round(max(l_extendedprice), 6) AS hi, 25 AS n_bins FROM lineitem GROUP BY ALL")
def bin_edges(spark, d):
    li = views.table(spark, d, "lineitem").groupBy((F.col("l_quantity").cast("int") % 5).alias("key")).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    e = li.select("key", binning.count_edges(F.col("lo"), F.col("hi"), 25).alias("edges"))
    return rounded(e.select("key", F.element_at("edges", 1).alias("lo"), F.element_at("edges", -1).alias("hi"), (F.size("edges") - 1).alias("n_bins")))


# ---------------------------------------------------------------- scattered points

_POINTS = "pt AS (SELECT s_nationkey % 3 AS key, s_acctbal / 1000 AS x, sqrt(s_suppkey) AS y, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey::DOUBLE END AS z FROM supplier), p AS (SELECT * FROM pt WHERE z IS NOT NULL)"


@query(f"""WITH {_POINTS}, e AS (SELECT key, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p GROUP BY ALL),
g AS (SELECT key, i::INT AS ix, j::INT AS iy, CASE WHEN i = 11 THEN x1 ELSE x0 + i * (x1 - x0) / 11 END AS x, CASE WHEN j = 9 THEN y1 ELSE y0 + j * (y1 - y0) / 9 END AS y FROM e, range(12) a(i), range(10) b(j)),
h AS (SELECT a.key, a.x AS ax, a.y AS ay, b.x AS ux, b.y AS uy FROM p a JOIN p b ON a.key = b.key AND (a.x, a.y) <> (b.x, b.y) WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.key = a.key AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
i AS (SELECT g.key, ix, iy, g.x, g.y, bool_and((ux - ax) * (g.y - ay) - (uy - ay) * (g.x - ax) >= -1e-9) AS inside FROM g JOIN h ON g.key = h.key GROUP BY ALL)
SELECT key::INT AS key, ix, iy, {_r('x')}, {_r('y')}, CASE WHEN inside THEN (SELECT arg_min(p.z, (p.x - i.x) ** 2 + (p.y - i.y) ** 2) FROM p WHERE p.key = i.key) END AS z FROM i""")
def scattered_nearest(spark, d):
    s = views.table(spark, d, "supplier")
    points = s.select((F.col("s_nationkey") % 3).cast("int").alias("key"), (F.col("s_acctbal") / 1000).alias("x"), F.sqrt("s_suppkey").alias("y"), F.when(F.col("s_suppkey") % 9 > 0, F.col("s_suppkey").cast("double")).alias("z"))
    return rounded(gridding.nearest_grid(gridding.with_coordinates(points, "key", ["x", "y"]), "key", "x", "y", "z", (12, 10)))


@query("SELECT key, nx, ny, n, nx * ny = n AS is_rectangular FROM (SELECT l_partkey % 50 AS key, count(DISTINCT l_suppkey) AS nx, count(DISTINCT l_linenumber) AS ny, count(DISTINCT (l_suppkey, l_linenumber)) AS n FROM lineitem GROUP BY ALL)")
def rectangular_points(spark, d):
    return gridding.rectangular(views.table(spark, d, "lineitem").withColumn("key", F.col("l_partkey") % 50), "key", "l_suppkey", "l_linenumber")


@query(f"""WITH p AS (SELECT event_type AS key, (hour(ts) // 6)::INT AS x, day(ts)::INT AS y, avg(value) AS z FROM events GROUP BY ALL), r AS (SELECT key FROM p GROUP BY key HAVING count(DISTINCT x) * count(DISTINCT y) = count(*))
SELECT key, row_number() OVER (PARTITION BY key ORDER BY y, x) AS place, (dense_rank() OVER (PARTITION BY key ORDER BY x) - 1)::INT AS ix, (dense_rank() OVER (PARTITION BY key ORDER BY y) - 1)::INT AS iy, x, y, {_r('z', digits=8)} FROM p JOIN r USING (key)""")
def rectangular_grid(spark, d):
    e = views.table(spark, d, "events").select(F.col("event_type").alias("key"), F.floor(F.hour("ts") / 6).cast("int").alias("x"), F.dayofmonth("ts").alias("y"), "value")
    return rounded(gridding.as_grid(e, "key", "x", "y", "value"), 8)


# ---------------------------------------------------------------- grids that grow with their table


@query(f"WITH RECURSIVE {_cells('order_lines')}, {_edges(False, False)}, {_COMP}, {_STATS} SELECT {_COMPONENT_COLUMNS} FROM comps")
def order_component_stats(spark, d):
    return rounded(_net(spark, d, "order_lines").components.drop("component", "wrap_x", "wrap_y"))


@query(_topology_sql("order_lines", False, True))
def order_topology(spark, d):
    return _net(spark, d, "order_lines", "periodic-y").topology.drop("note")


@query(_global_sql("order_lines", True, False))
def order_global(spark, d):
    return rounded(_net(spark, d, "order_lines", "periodic-x").globals)


@query(f"""WITH {_cells('order_lines')}, s AS (SELECT step_index, ix, iy, CASE WHEN phase = 'matrix' THEN ncount END AS v FROM c), {_weights_sql(0.8)},
n AS (SELECT b.step_index, b.ix - p.k AS ix, b.iy - q.k AS iy, sum(b.v * p.w * q.w) AS num, sum(p.w * q.w) AS den FROM s b, w p, w q WHERE b.v IS NOT NULL GROUP BY ALL)
SELECT s.step_index, s.ix, s.iy, s.v, round(num / den, 6) AS smooth FROM s LEFT JOIN n USING (step_index, ix, iy)""")
def order_smooth_2d(spark, d):
    cells = _net(spark, d, "order_lines").cells.select("step_index", "ix", "iy", F.when(F.col("phase") == "matrix", F.col("ncount")).alias("v"))
    return rounded(smoothing.smooth_2d(cells, "step_index", "ix", "iy", "v", 0.8, keep_null=False))


_BACKGROUND = """st AS (SELECT step_index, max(nx) AS nx, max(ny) AS ny FROM c GROUP BY ALL), full_ AS (SELECT step_index, a.i::INT AS jx, b.i::INT AS jy FROM st, range((SELECT max(nx) FROM c)) a(i), range((SELECT max(ny) FROM c)) b(i) WHERE a.i < nx AND b.i < ny),
bg AS (SELECT f.step_index, jx, jy FROM full_ f LEFT JOIN c ON c.step_index = f.step_index AND ix = jx AND iy = jy AND phase = 'matrix' WHERE k IS NULL)"""


@query(f"WITH {_cells('order_lines')}, {_BACKGROUND} SELECT c.step_index, ix, iy, round(sqrt(min((ix - jx) ** 2 + (iy - jy) ** 2)), 6) AS distance FROM c LEFT JOIN bg ON c.step_index = bg.step_index WHERE phase = 'matrix' GROUP BY ALL")
def order_distance(spark, d):
    net = _net(spark, d, "order_lines")
    return rounded(morphology.distances(net.cells, net.b, "matrix"))


# ---------------------------------------------------------------- block files, through the data source


@query("""WITH g AS (SELECT (l_orderkey // 32)::INT AS step, l_orderkey::DOUBLE AS x, l_linenumber::DOUBLE AS y, sum(l_quantity)::DOUBLE AS n FROM lineitem GROUP BY ALL), top AS (SELECT max(step) AS top FROM g),
r AS (SELECT dense_rank() OVER (ORDER BY step)::INT AS step_index, step * 10.0::DOUBLE AS timestep, (count(*) OVER (PARTITION BY step))::INT AS num_chunks, sum(n) OVER (PARTITION BY step) AS total_count, (row_number() OVER (PARTITION BY step ORDER BY x, y))::INT AS row_id, x AS "Coord1", y AS "Coord2", n AS "Ncount" FROM g)
SELECT r.* FROM r, top WHERE timestep >= 5.0 * top""")
def block_format(spark, d):
    """Grids as block files, written and read through the format; of the blocks only those of the upper half are parsed."""
    cells = materialize(views.order_lines(spark, d), "block-cells")
    row_id = F.row_number().over(W.partitionBy("step_index").orderBy("x", "y"))  # of one grid
    rows = cells.select("step_index", (F.col("step_index") * 10.0).alias("timestep"), row_id.alias("row_id"), F.col("x").alias("Coord1"), F.col("y").alias("Coord2"), F.col("ncount").alias("Ncount"))
    folder = scratch(spark, "block-files")
    datasource.register(spark)
    datasource.save(rows, folder)
    top = cells.agg(F.max("step_index")).first()[0] or 0
    return datasource.load(spark, folder, scratch(spark, "block-index")).where(F.col("timestep") >= 5.0 * top).drop("path")


# ---------------------------------------------------------------- skeletons that are given, and the statistics tree

_GIVEN = "phase = 'matrix' AND (ix + iy) % 3 > 0"


@query(f"""WITH {_cells('cells_step')}, {_BACKGROUND},
t AS (SELECT c.step_index, 2 * sqrt(min((ix - jx) ** 2 + (iy - jy) ** 2)) AS t FROM c JOIN bg ON c.step_index = bg.step_index WHERE {_GIVEN} GROUP BY c.step_index, ix, iy)
SELECT step_index, round(min(t), 6) AS min, round(avg(t), 6) AS mean, round(quantile_cont(t, 0.01), 6) AS p1, round(quantile_cont(t, 0.05), 6) AS p5, count(*) AS sample_count FROM t GROUP BY ALL""")
def thickness_given(spark, d):
    net = _net(spark, d, "cells_step")
    return rounded(morphology.thickness(net.cells, net.b, 1.0, 1.0, "matrix", net.cells.where(_GIVEN)))


@query(f"""WITH {_cells('cells_step')}, s AS (SELECT step_index, ix, iy FROM c WHERE {_GIVEN}), ring AS (SELECT * FROM (VALUES (0, 0, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, -1, 1), (6, -1, 0), (7, -1, -1)) r(k, dx, dy)),
n AS (SELECT a.step_index, a.ix, a.iy, list(k) AS ks, sum(sqrt(dx * dx + dy * dy)) / 2 AS len FROM s a JOIN ring ON true JOIN s b ON b.step_index = a.step_index AND b.ix = a.ix + dx AND b.iy = a.iy + dy GROUP BY ALL),
m AS (SELECT *, len(list_filter(range(8), lambda k: NOT list_contains(ks, k) AND list_contains(ks, (k + 1) % 8))) AS runs FROM n),
f AS (SELECT step_index, count(*) FILTER (runs >= 3) AS branch_points, count(*) FILTER (len(ks) = 1) AS end_points, sum(len) AS l FROM m GROUP BY ALL), a AS (SELECT step_index, count(*) FILTER (phase = 'matrix') AS area FROM c GROUP BY ALL)
SELECT step_index, round(coalesce(l, 0), 6) AS skeleton_length, coalesce(branch_points, 0) AS branch_points, coalesce(end_points, 0) AS end_points, round(CASE WHEN area = 0 THEN 0 ELSE coalesce(branch_points, 0) / area END, 6) AS branch_density FROM a LEFT JOIN f USING (step_index)""")
def skeleton_given(spark, d):
    net = _net(spark, d, "cells_step")
    return rounded(morphology.skeleton_stats(net.cells, net.cells.where(_GIVEN), net.b, "matrix", 1.0, 1.0))


@query(_series_sql(False) + """ JOIN (SELECT step_index, max(nx) AS nx, max(ny) AS ny, max(nx) * max(ny) - count(*) AS missing_cells, count(*)::DOUBLE AS valid_area FROM c GROUP BY ALL) USING (step_index)
JOIN (SELECT step_index, bool_or(percolates_x) AS pore_percolates_x, bool_or(percolates_y) AS pore_percolates_y, count(*) FILTER (percolates_y) AS pore_connected_y FROM comps WHERE phase = 'pore' GROUP BY ALL) USING (step_index)""")
def network_stats_flat(spark, d):
    s = _net(spark, d, "cells_step", skeleton=False).stats
    per = lambda p: [*(F.col(f"topology.{p}.{c}").alias(f"{p}_{c}") for c in ("beta0", "beta1", "chi")), *(F.col(f"size.{p}.{c}").alias(f"{p}_{c}") for c in ("largest_fraction", "mean_diameter", "max_diameter"))]
    conn = [F.col("connectivity.pore.x.percolates").alias("pore_percolates_x"), F.col("connectivity.pore.y.percolates").alias("pore_percolates_y"), F.col("connectivity.pore.y.component_count").alias("pore_connected_y")]
    return rounded(s.select("step_index", "geometry.porosity", "geometry.interface_length", "geometry.specific_interface", *per("pore"), *per("matrix"), "meta.nx", "meta.ny", "meta.missing_cells", "geometry.valid_area", *conn))
