"""The engine's queries over the standard tables, and their SQL for DuckDB.

Networks: trade (customer nation x supplier nation, cents), trade_sym (both directions); partition: nations by region.
Data: embeddings (64 features). Values are rounded where floating-point sums may differ in order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sphere
from .operators import canonical, clustering, embedding, linalg, moments, neighbors, objectives
from .sources.frames import Network, from_dense, vectors


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trade(spark: SparkSession, sf: str, both: bool = False) -> Network:
    """Trade in cents. Line items are summed by order and supplier nation before they meet the orders; orders know their customer's nation by then."""
    l, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    lines = (
        l.select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
        .join(s.select("s_suppkey", F.col("s_nationkey").alias("j")), l.l_suppkey == s.s_suppkey)
        .groupBy("l_orderkey", "j").agg(F.sum("cents").alias("cents"))
    )
    orders = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", F.col("c_nationkey").alias("i")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "i")
    e = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("i", "j").agg(F.sum("cents").cast("double").alias("w"))
    if both:
        e = e.union(e.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    return Network.of(e, nodes)


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("int").alias("m"))


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.col("label").cast("int").alias("m"))


def halves(spark: SparkSession, sf: str) -> DataFrame:
    return emb(spark, sf).select("i", F.slice("x", 1, 32).alias("x"), F.slice("x", 33, 32).alias("y"))


def _r(c: str, digits: int, by: float = 1.0):
    return (F.round(F.col(c) / by, digits) + 0.0).alias(c)


def _matrix(spark: SparkSession, a: np.ndarray) -> DataFrame:
    return from_dense(spark, a, keep_zeros=True).edges


_CENTS = """trade as (select c_nationkey::bigint as i, s_nationkey::bigint as j, sum(round(l_extendedprice * 100)::bigint)::double as w from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join supplier on l_suppkey = s_suppkey group by all),
nodes as (select n_nationkey::bigint as i, n_regionkey::int as m from nation), nn as (select count(*)::double as n from nodes),
sym as (select i, j, sum(w) as w from (select i, j, w from trade union all select j, i, w from trade) group by all)"""
_MODULES = """, e as (select s.i, s.j, s.w, a.m as mi, b.m as mj from sym s join nodes a on s.i = a.i join nodes b on s.j = b.i), t as (select sum(w) as t from sym),
mod as (select mi as m, sum(case when mi = mj then w else 0 end) as c, sum(w) as d, (select count(*) from nodes where m = mi)::double as n from e group by mi), k as (select count(*)::double as k from (select distinct m from nodes))"""
_EMB = """e as (select vec_id::bigint as i, label::int as m, list_transform(embedding, lambda v: v::double) as x from embeddings)"""
_LONG = """, long as (select i, m, unnest(range(len(x))) as p, unnest(x) as v from e)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {_CENTS} select nodes.i, coalesce(sum(w), 0)::double as value from nodes left join trade on nodes.i = trade.i group by nodes.i")
def g1_degree_first(spark, sf):
    return moments.degree(trade(spark, sf))


@query(f"with {_CENTS} select nodes.i, round(coalesce(sum(w * w), 0) / 1e12, 4) + 0.0 as value from nodes left join trade on nodes.i = trade.i group by nodes.i")
def g2_degree_second(spark, sf):
    return moments.degree(trade(spark, sf), "second").select("i", _r("value", 4, 1e12))


def _power(source: str) -> str:
    """The leading singular triple of a matrix of nations, by 400 rounds of power iteration on lists: u and v by row number from 1, and s."""
    dot = "list_transform({m}, lambda r: list_dot_product(r, {v}))"
    both = dot.format(m="t", v=dot.format(m="a", v="v"))
    return f""", grid as (select x.i, y.i as j, coalesce(w, 0) as w from nodes x cross join nodes y left join {source} e on e.i = x.i and e.j = y.i),
mats as (select (select list(r order by i) from (select i, list(w order by j) as r from grid group by i)) as a, (select list(r order by j) from (select j, list(w order by i) as r from grid group by j)) as t),
power as (select 0 as it, list_transform(range(25), lambda x: 1.0::double) as v union all
  select it + 1, list_transform(z, lambda x: x / sqrt(list_dot_product(z, z))) from (select it, {both} as z from power, mats where it < 400)),
top as (select v, {dot.format(m="a", v="v")} as au from power, mats where it = 400),
triple as (select sqrt(list_dot_product(au, au)) as s, list_transform(au, lambda x: x / sqrt(list_dot_product(au, au))) as u, v from top),
place as (select i, row_number() over (order by i) as pos from nodes)"""


_RECURSIVE = _CENTS.replace("trade as", "recursive trade as", 1)


@query(f"with {_RECURSIVE}{_power('trade')} select nodes.i, round((coalesce(sum(w), 0) - max(u[pos] * s * list_sum(v))) / 1e8, 4) + 0.0 as value from nodes join place using (i) cross join triple left join trade on nodes.i = trade.i group by nodes.i")
def g3_degree_residual(spark, sf):
    return moments.degree(trade(spark, sf), "residual").select("i", _r("value", 4, 1e8))


@query(f"with {_CENTS} select nodes.i, round((sum(w*w) / max(n) - pow(sum(w) / max(n), 2)) / pow(sum(w) / max(n), 2), 8) + 0.0 as value from nodes cross join nn left join trade on nodes.i = trade.i group by nodes.i")
def v1_coefvar2(spark, sf):
    return moments.dispersion(trade(spark, sf)).select("i", _r("value", 8))


@query(f"""with {_CENTS}, sizes as (select m, count(*)::double as size from nodes group by m), x as (select s.i, b.m, sum(w) / max(size) as x from sym s join nodes b on s.j = b.i join sizes on sizes.m = b.m group by s.i, b.m)
select nodes.i, round(1 - sum(x * x) / pow(sum(x), 2), 8) + 0.0 as value from nodes left join x on nodes.i = x.i group by nodes.i""")
def v2_kpartcoef(spark, sf):
    return moments.dispersion(trade(spark, sf, True), "kpartcoef", regions(spark, sf)).select("i", _r("value", 8))


_CELLS = f"""with {_CENTS}, so as (select nodes.i, coalesce(sum(w), 0) as so from nodes left join trade on nodes.i = trade.i group by nodes.i), si as (select nodes.i as j, coalesce(sum(w), 0) as si from nodes left join trade on nodes.i = trade.j group by nodes.i),
t as (select sum(w) as t from trade)"""


@query(f"{_CELLS} select so.i, si.j, round((coalesce(w, 0) - so * si / t) / 1e6, 4) + 0.0 as w from so cross join si cross join t left join trade on trade.i = so.i and trade.j = si.j")
def r1_residual_degree(spark, sf):
    return moments.residual(trade(spark, sf), "degree").select("i", "j", _r("w", 4, 1e6))


@query(f"{_CELLS} select so.i, si.j, round((coalesce(w, 0) - so / n - si / n + t / n / n) / 1e6, 4) + 0.0 as w from so cross join si cross join t cross join nn left join trade on trade.i = so.i and trade.j = si.j")
def r2_residual_degree_ctr(spark, sf):
    return moments.residual(trade(spark, sf), "degree_ctr").select("i", "j", _r("w", 4, 1e6))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.posexplode("x").alias("p", "v")).select("i", F.col("p").cast("long").alias("p"), _r("v", 8))


@query(f"with {_EMB}{_LONG}, g as (select p, avg(v) as g from long group by p), s as (select i, sum(v * g) / (select sum(g * g) from g) as s from long join g using (p) group by i) select i, p::bigint as p, round(v - s * g, 8) + 0.0 as v from long join g using (p) join s using (i)")
def r3_residual_global(spark, sf):
    return _long(moments.residual_rows(emb(spark, sf), "global"))


@query(f"with {_EMB}{_LONG}, g as (select p, avg(v) as g from long group by p) select i, p::bigint as p, round(v - g, 8) + 0.0 as v from long join g using (p)")
def r4_residual_global_ctr(spark, sf):
    return _long(moments.residual_rows(emb(spark, sf), "global_ctr"))


@query(f"with {_RECURSIVE}{_power('trade')} select grid.i, grid.j, round((w - s * u[p.pos] * v[q.pos]) / 1e8, 4) + 0.0 as w from grid join place p on p.i = grid.i join place q on q.i = grid.j cross join triple")
def r5_residual_rankone(spark, sf):
    return moments.residual(trade(spark, sf), "rankone").select("i", "j", _r("w", 4, 1e8))


@query(f"with {_CENTS}, a as (select i, j from (select i, j, row_number() over (partition by i order by w desc, j) as r from trade where i <> j) where r <= 5) select distinct i, j, 1::bigint as c from (select i, j from a union all select j, i from a)")
def n2_nearest_network(spark, sf):
    return neighbors.kneighbor(trade(spark, sf), "nearest", 5)


def _nearest(centre: bool) -> str:
    x = "list_transform(x, lambda v: v - list_avg(x))" if centre else "x"
    return f"""with {_EMB}, y as (select i, {x} as x from e), u as (select i, x, sqrt(list_dot_product(x, x)) as s from y),
a as (select i, j from (select p.i, q.i as j, row_number() over (partition by p.i order by round(list_dot_product(p.x, q.x) / p.s / q.s, 10) desc, q.i) as r from u p, u q where p.i <> q.i) where r <= 10)"""


@query(_nearest(True) + " select distinct i, j, 1::bigint as c from (select i, j from a union all select j, i from a)")
def n3_nearest_corr(spark, sf):
    return neighbors.kneighbor(emb(spark, sf), "nearest", 10, "corr")


@query(_nearest(False) + " select p.i, q.i as j, count(*) as c from a p join a q on p.j = q.j group by p.i, q.i")
def n8_common_cosim(spark, sf):
    return neighbors.kneighbor(emb(spark, sf), "common", 10, "cosim")


@query()
def n6_nearest_indirect(spark, sf):
    return neighbors.kneighbor(emb(spark, sf), "nearest", 10, "cosim", "indirect")


def _similar_sql(expr: str) -> str:
    return f"with {_EMB}{_LONG}, s as (select i, avg(v) as a, sqrt(sum(v * v)) as s, sqrt(sum(v * v) - sum(v) * sum(v) / count(*)) as c, sqrt(count(*)) as r from long group by i) select i, p::bigint as p, round({expr}, 8) + 0.0 as v from long join s using (i)"


def _add_similar(kind: str, expr: str) -> None:
    def f(spark, sf):
        from .functions import vectors as v

        return _long(emb(spark, sf).select("i", v.similar(F.col("x"), kind).alias("x")))

    f.__name__ = f"similarity_{kind}"
    query(_similar_sql(expr))(f)


for _kind, _expr in {"corr": "(v - a) / c", "cosim": "v / s", "cov": "(v - a) / r", "dot": "v / r"}.items():
    _add_similar(_kind, _expr)


def _add_objective(name: str, objective: str, value: str) -> None:
    def f(spark, sf):
        scale = 1e6 if objective == "kmeans" else 1.0
        return objectives.quality(trade(spark, sf, True), regions(spark, sf), objective).select(_r("q", 3 if objective == "kmeans" else 8, scale))

    f.__name__ = name
    query(f"with {_CENTS}{_MODULES} select {value} + 0.0 as q from mod, t, k, nn")(f)


_CTR = "(c - 2 * mod.n * d / nn.n + mod.n * mod.n * t / nn.n / nn.n)"
for _name, _objective, _value in (
    ("l1_kmeans", "kmeans", "round(sum(c / mod.n) / 1e6, 3)"),
    ("l2_kmodularity", "kmodularity", "round(sum(nn.n / k * (c - d * d / t) / mod.n / t), 8)"),
    ("l3_kmodularity_ctr", "kmodularity_ctr", f"round(sum(nn.n / k * {_CTR} / mod.n / t), 8)"),
    ("l4_modularity", "modularity", "round(sum((c - d * d / t) / t), 8)"),
    ("l5_modularity_ctr", "modularity_ctr", f"round(sum({_CTR} / t), 8)"),
    ("l6_spectral", "spectral", "round(sum(c / d), 8)"),
):
    _add_objective(_name, _objective, _value)


@query(f"with {_EMB}{_LONG}, s as (select m, p, sum(v) / 8 as s, count(*) as n from long group by m, p) select round(sum(s * s / n), 6) + 0.0 as q from s")
def l1_kmeans_rows(spark, sf):
    return objectives.quality_rows(emb(spark, sf), labels(spark, sf)).select(_r("q", 6))


def _gain_sql(v: str, vu: str) -> str:
    return f"""with {_CENTS}{_MODULES}, st as (select m, c / t as c, {v} as v, n from mod, t), node as (select nodes.i, nodes.m as a, coalesce(max(case when sym.j = nodes.i then w end), 0) / max(t) as wii, {vu} as vu from nodes cross join t left join sym on sym.i = nodes.i group by nodes.i, nodes.m),
s as (select i, mj as m, sum(w) / max(t) as s from e, t group by i, mj)
select node.i, b.m, round((b.c + 2 * coalesce(sb.s, 0) + wii) / (b.v + vu) - b.c / b.v + (a.c - 2 * coalesce(sa.s, 0) + wii) / (a.v - vu) - a.c / a.v, 8) + 0.0 as gain
from node join st a on a.m = node.a cross join st b left join s sb on sb.i = node.i and sb.m = b.m left join s sa on sa.i = node.i and sa.m = node.a where a.n > 1 and b.m <> node.a"""


def _scaled(net: Network) -> Network:
    t = net.edges.agg(F.sum("w")).first()[0]
    return Network(net.edges.withColumn("w", F.col("w") / t), net.rows, net.cols, net.n_rows, net.n_cols)


@query(_gain_sql("n", "1"))
def l19_gains_kmeans(spark, sf):
    return objectives.gains(_scaled(trade(spark, sf, True)), regions(spark, sf), "kmeans").select("i", "m", _r("gain", 8))


@query(_gain_sql("d / t", "coalesce(sum(w), 0) / max(t)"))
def l19_gains_spectral(spark, sf):
    return objectives.gains(_scaled(trade(spark, sf, True)), regions(spark, sf), "spectral").select("i", "m", _r("gain", 8))


_BLOCKS = f"with {_CENTS}, b as (select x.m as mx, y.m as my, sum(w) as c from trade join nodes x on trade.i = x.i join nodes y on trade.j = y.i group by all), z as (select m, count(*)::double as n from nodes group by m)"


@query(f"{_BLOCKS} select mx, my, round(c / sqrt(p.n * q.n) / 1e6, 4) + 0.0 as c from b join z p on p.m = mx join z q on q.m = my")
def b6_blocks(spark, sf):
    return objectives.blocks(trade(spark, sf), regions(spark, sf), regions(spark, sf)).select("mx", "my", _r("c", 4, 1e6))


@query(f"{_BLOCKS} select round(sum(c / sqrt(p.n * q.n)) / 1e6, 4) + 0.0 as q from b join z p on p.m = mx join z q on q.m = my where mx = my")
def b4_cokmeans(spark, sf):
    return objectives.co_quality(trade(spark, sf), regions(spark, sf), regions(spark, sf)).select(_r("q", 4, 1e6))


@query(f"{_BLOCKS}, dx as (select mx as m, sum(c) as d from b group by mx), dy as (select my as m, sum(c) as d from b group by my) select round(sum(c / sqrt(p.d * q.d)), 8) + 0.0 as q from b join dx p on p.m = mx join dy q on q.m = my where mx = my")
def b4_cospectral(spark, sf):
    return objectives.co_quality(trade(spark, sf), regions(spark, sf), regions(spark, sf), "spectral").select(_r("q", 8))


@query(f"with {_CENTS} select s.i, b.m, sum(w)::double as w from sym s join nodes b on s.j = b.i group by s.i, b.m")
def u3_module_weights(spark, sf):
    return embedding.module_weights(trade(spark, sf, True), regions(spark, sf))


@query(f"with {_EMB}{_LONG}, c as (select i, p, v - avg(v) over (partition by p) as v from long) select x.p::bigint as i, (y.p - 32)::bigint as j, round(sum(x.v * y.v), 6) + 0.0 as w from c x join c y on x.i = y.i where x.p < 32 and y.p >= 32 group by x.p, y.p")
def a2_cross_covariance(spark, sf):
    rows = canonical._centred(halves(spark, sf), False)
    return _matrix(spark, linalg.cross(rows, 32, 32)).select("i", "j", _r("w", 6))


@query("select k::bigint as i, round(cos(2 * pi() * (k + 0.5) / ((1 + sqrt(5)) / 2)) * sin(acos(1 - 2 * (k + 0.5) / 144)), 8) + 0.0 as x, round(sin(2 * pi() * (k + 0.5) / ((1 + sqrt(5)) / 2)) * sin(acos(1 - 2 * (k + 0.5) / 144)), 8) + 0.0 as y, round(1 - 2 * (k + 0.5) / 144, 8) + 0.0 as z from range(144) r(k)")
def u13_fibonacci_sphere(spark, sf):
    return sphere.fibonacci(spark, 144).select("i", _r("x", 8), _r("y", 8), _r("z", 8))


def _points(spark, sf):
    return emb(spark, sf).select("i", *(F.get("x", F.lit(k)).alias(c) for k, c in enumerate("xyz")))


@query(f"with {_EMB}, u as (select i, x[1] as x, x[2] as y, x[3] / sqrt(x[1]*x[1] + x[2]*x[2] + x[3]*x[3]) as z from e) select i, round(atan2(y, x), 8) + 0.0 as px, round(ln((1 + z) / (1 - z)) / 2, 8) + 0.0 as py from u")
def u14_mercator(spark, sf):
    return sphere.mercator(_points(spark, sf)).select("i", _r("px", 8), _r("py", 8))


@query()
def u15_rotation(spark, sf):
    return sphere.rotation(_points(spark, sf))[0]


_OFF = f"""{_CELLS}, a as (select so.i, si.j, coalesce(w, 0) - so * si / t as x, coalesce(w, 0) - so / n - si / n + t / n / n as y from so cross join si cross join t cross join nn left join trade on trade.i = so.i and trade.j = si.j)"""


@query(f"{_OFF} select round(corr(x, y), 8) + 0.0 as r from a where i <> j")
def q1_residual_correlation(spark, sf):
    net = trade(spark, sf)
    a, b = moments.residual(net, "degree").withColumnRenamed("w", "x"), moments.residual(net, "degree_ctr").withColumnRenamed("w", "y")
    return a.join(b, ["i", "j"]).where("i <> j").agg(F.corr("x", "y").alias("r")).select(_r("r", 8))


@query(f"with {_RECURSIVE}{_power('sym')}, d as (select nodes.i, coalesce(sum(w), 0) as d from nodes left join sym on nodes.i = sym.i group by nodes.i) select round(corr(d, u[pos]), 8) + 0.0 as r from d join place using (i) cross join triple")
def q8_degree_and_eigenvector(spark, sf):
    net = trade(spark, sf, True)
    return moments.degree(net).join(linalg.leading(net)[0], "i").agg(F.corr("value", "u").alias("r")).select(_r("r", 8))


@query(f"""{_nearest(False)}, c as (select p.i, q.i as j, count(*)::double as w from a p join a q on p.j = q.j group by p.i, q.i), n as (select count(*)::double as n from e), sizes as (select m, count(*)::double as size from e group by m),
cv as (select e.i, (sum(w * w) / max(n) - pow(sum(w) / max(n), 2)) / pow(sum(w) / max(n), 2) as cv2 from e cross join n left join c on c.i = e.i group by e.i),
x as (select c.i, e.m, sum(w) / max(size) as x from c join e on c.j = e.i join sizes on sizes.m = e.m group by c.i, e.m)
select cv.i, round(any_value(cv2), 8) + 0.0 as cv2, round(1 - sum(x * x) / pow(sum(x), 2), 8) + 0.0 as participation from cv left join x on x.i = cv.i group by cv.i""")
def q10_dispersion_of_common_neighbours(spark, sf):
    rows = emb(spark, sf)
    net = Network.of(neighbors.kneighbor(rows, "common", 10, "cosim").select("i", "j", F.col("c").cast("double").alias("w")), rows.select("i"))
    got = moments.dispersion(net).withColumnRenamed("value", "cv2").join(moments.dispersion(net, "kpartcoef", labels(spark, sf)).withColumnRenamed("value", "participation"), "i")
    return got.select("i", _r("cv2", 8), _r("participation", 8))


@query()
def k_shrinkage(spark, sf):
    return linalg.shrinkage(trade(spark, sf, True)).edges


@query()
def c2_neighbor_components(spark, sf):
    return neighbors.components(emb(spark, sf), 3, neighbours=10, similarity="cosim")


@query()
def c3_neighbor_modules(spark, sf):
    return neighbors.components(emb(spark, sf), 5, "binary", neighbours=10, similarity="cosim", replicates=4)


def _with_q(found):
    p, q = found[0], found[-1]
    return p.withColumn("q", F.lit(float(q)))


def _add_loyvain(objective: str) -> None:
    def f(spark, sf):
        return _with_q(clustering.loyvain(trade(spark, sf, True), 5, objective, replicates=4))

    f.__name__ = f"loyvain_{objective}"
    query()(f)


for _objective in ("kmeans", "kmodularity", "kmodularity_ctr", "modularity", "modularity_ctr", "spectral"):
    _add_loyvain(_objective)


@query()
def loyvain_rows(spark, sf):
    return _with_q(clustering.loyvain(emb(spark, sf), 10, "kmodularity", "corr", replicates=4))


@query()
def loyvain_distributed(spark, sf):
    return _with_q(clustering.distributed(emb(spark, sf), 10, "kmeans", "corr", sweeps=3, numbatches=2))


def _add_coloyvain(objective: str) -> None:
    def f(spark, sf):
        x, y, q, _ = clustering.coloyvain(trade(spark, sf), 4, objective, replicates=4)
        return x.withColumn("side", F.lit("x")).union(y.withColumn("side", F.lit("y"))).withColumn("q", F.lit(float(q)))

    f.__name__ = f"coloyvain_{objective}"
    query()(f)


for _objective in ("kmeans", "kmodularity", "spectral"):
    _add_coloyvain(_objective)


@query()
def m_modularity(spark, sf):
    return _with_q(clustering.modularity(trade(spark, sf, True), replicates=4, finaltune=True))


def region_trade(spark: SparkSession, sf: str, both: bool = False) -> Network:
    """Trade between the five regions: small enough for SQL to try every partition."""
    r = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    e = trade(spark, sf, both).edges
    e = e.join(F.broadcast(r.toDF("i", "ri")), "i").join(F.broadcast(r.toDF("j", "rj")), "j")  # 25 nations
    return Network.of(e.select(F.col("ri").alias("i"), F.col("rj").alias("j"), "w"), r.select(F.col("r").alias("i")).distinct())


def _first(p: DataFrame, key: str = "m") -> DataFrame:
    """Labels as the least node of the module: (i, m)."""
    from pyspark.sql import Window as W

    return p.withColumn("m", F.min("i").over(W.partitionBy(key)).cast("int"))


_REGIONS = f"""with {_CENTS}, net as (select a.m::bigint as i, b.m::bigint as j, sum(w) as w from {{edges}} e join nodes a on e.i = a.i join nodes b on e.j = b.i group by all),
node as (select distinct m::bigint as i from nodes), t as (select sum(w) as t from net)"""


def _best_partition(objective_value: str, labels: int, all_used: bool) -> str:
    """SQL that tries every labelling of the regions and returns the best one."""
    return f"""{_REGIONS.format(edges="sym")}, p as (select b, i, (b // pow({labels}, i)::int) % {labels} as m from range({labels ** 5}) r(b), node),
size as (select b, m, count(*)::double as n from p group by b, m), used as (select b from size group by b having count(*) {"=" if all_used else "<="} {labels}),
deg as (select b, m, sum(w) as d from p join net using (i) group by b, m), inside as (select x.b, x.m, sum(w) as c from p x join net on net.i = x.i join p y on y.b = x.b and y.i = net.j and y.m = x.m group by x.b, x.m),
q as (select size.b, {objective_value} as q from size join used using (b) join deg using (b, m) left join inside using (b, m) cross join t group by size.b),
best as (select b, q from q order by round(q, 9) desc, b limit 1)
select p.i, (min(p.i) over (partition by p.m))::int as m, round(q, 8) + 0.0 as q from best join p using (b)"""


_C = "coalesce(c, 0)"
_RCTR = f"({_C} - 2 * n * d / 5 + n * n * t / 25)"
for _objective, _value in (
    ("kmeans", f"sum({_C} / n) / 1e12"), ("kmodularity", f"sum(5.0 / 2 * ({_C} - d * d / t) / n / t)"), ("kmodularity_ctr", f"sum(5.0 / 2 * {_RCTR} / n / t)"), ("modularity", f"sum(({_C} - d * d / t) / t)"),
    ("modularity_ctr", f"sum({_RCTR} / t)"), ("spectral", f"sum({_C} / d)"),
):
    def _regions_loyvain(spark, sf, objective=_objective):
        p, q = clustering.loyvain(region_trade(spark, sf, True), 2, objective)
        return _first(p).withColumn("q", F.lit(round(float(q) / (1e12 if objective == "kmeans" else 1), 8) + 0.0))

    _regions_loyvain.__name__ = f"loyvain_regions_{_objective}"
    query(_best_partition(_value, 2, not _objective.startswith("modularity")))(_regions_loyvain)


@query(_best_partition(f"sum(({_C} - d * d / t) / t)", 5, False))
def m_modularity_regions(spark, sf):
    p, q = clustering.modularity(region_trade(spark, sf, True), finaltune=True)
    return _first(p).withColumn("q", F.lit(round(float(q), 8) + 0.0))


def _best_pair(value: str) -> str:
    """SQL that tries every pair of labellings of the regions as customers and as suppliers."""
    return f"""{_REGIONS.format(edges="trade")}, p as (select b, i, (b >> i::int) & 1 as m from range(1, 31) r(b), node),
ends as (select b, m, count(*)::double as n, sum(so) as dx, sum(si) as dy from p join (select i, sum(w) as so from net group by i) using (i) join (select j as i, sum(w) as si from net group by j) using (i) group by b, m),
block as (select x.b as bx, y.b as b, x.m, sum(w) as c from p x join net on net.i = x.i join p y on y.i = net.j and y.m = x.m group by x.b, y.b, x.m),
q as (select bx, block.b, {value} as q from block join ends x on x.b = bx and x.m = block.m join ends y on y.b = block.b and y.m = block.m cross join t group by bx, block.b),
best as (select bx, b, q from q order by round(q, 9) desc, bx, b limit 1), name as (select p.m, min(p.i)::int as first from best join p on p.b = bx group by p.m)
select 'x' as side, p.i, first as m, round(q, 8) + 0.0 as q from best join p on p.b = bx join name using (m) union all select 'y', p.i, first, round(q, 8) + 0.0 from best join p on p.b = best.b join name using (m)"""


for _objective, _value in (("kmeans", "sum(c / sqrt(x.n * y.n)) / 1e12"), ("kmodularity", "sum(5.0 / 2 / t * (c - x.dx * y.dy / t) / sqrt(x.n * y.n))")):  # for spectral the local search does not reach the best pair, see README
    def _regions_coloyvain(spark, sf, objective=_objective):
        x, y, q, _ = clustering.coloyvain(region_trade(spark, sf), 2, objective, start="random", replicates=60)
        both = x.withColumn("side", F.lit("x")).union(y.withColumn("side", F.lit("y")))
        name = x.groupBy("m").agg(F.min("i").cast("int").alias("first"))
        return both.join(name, "m").select("side", "i", F.col("first").alias("m"), F.lit(round(float(q) / (1e12 if objective == "kmeans" else 1), 8) + 0.0).alias("q"))

    _regions_coloyvain.__name__ = f"coloyvain_regions_{_objective}"
    query(_best_pair(_value))(_regions_coloyvain)


def _add_canoncov(kind: str, corr: bool) -> None:
    def f(spark, sf):
        _, _, scores, r = canonical.canoncov(halves(spark, sf), 3, kind, resid=False, corr=corr, **({"replicates": 2} if kind == "binary" else {}))
        return scores.select("i", "u", "v", F.array(*map(F.lit, map(float, r))).alias("r"))

    f.__name__ = f"canoncov_{kind}" + "_corr" * corr
    query()(f)


for _kind, _corr in (("weighted", False), ("weighted", True), ("binary", False)):
    _add_canoncov(_kind, _corr)


@query()
def mumap(spark, sf):
    u, m, _ = embedding.mumap(emb(spark, sf), kappa=15, maxiter=100, learnrate=0.05, replicates=2)
    return u.join(m, "i")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
