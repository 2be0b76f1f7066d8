"""Electoral inputs derived from the given tables, in Spark and in SQL.

Units are customers, communes are nations, regions are regions. Votes are
ordered quantities by part brand or part type, population counts orders.
Everything uses integer arithmetic, so both engines see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hemicycle.checks.base import cte
from hemicycle.functions.frames import shuffled, sized

PLANS, DISTRICTS = 8, 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def units(spark, sf) -> DataFrame:
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("commune"), F.col("n_regionkey").alias("region")
    )
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("commune")
    )
    return customer.join(nation, "commune")


cte("units", """SELECT c_custkey AS unit_id, c_nationkey AS commune, n_regionkey AS region
FROM customer JOIN nation ON c_nationkey = n_nationkey""")


def population(spark, sf) -> DataFrame:
    """Orders per customer, 0 for customers without orders."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("unit_id")).agg(
        F.count(F.lit(1)).alias("population")
    )
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"))
    return customer.join(shuffled(counts), "unit_id", "left").fillna(0, ["population"])


cte("population", """SELECT c_custkey AS unit_id, COALESCE(n, 0) AS population FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")


def unit_frame(spark, sf) -> DataFrame:
    return units(spark, sf).join(shuffled(population(spark, sf)), "unit_id")


cte("unit_frame", "SELECT * FROM units JOIN population USING (unit_id)")


def _sold(spark, sf, party: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("unit_id"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(party).alias("party"))
    return lines.join(shuffled(orders), "l_orderkey").join(sized(part), "l_partkey")


def unit_votes(spark, sf) -> DataFrame:
    """Quantity by (customer, part type)."""
    return _sold(spark, sf, "p_type").groupBy("unit_id", "party").agg(
        F.sum("l_quantity").cast("long").alias("votes")
    )


cte("unit_votes", """SELECT o_custkey AS unit_id, p_type AS party, CAST(sum(l_quantity) AS BIGINT) AS votes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")


def district_votes(spark, sf) -> DataFrame:
    """Quantity by (nation, part brand): 25 districts and 25 parties."""
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("unit_id"), F.col("c_nationkey").alias("district")
    )
    sold = _sold(spark, sf, "p_brand").groupBy("unit_id", "party").agg(F.sum("l_quantity").alias("q"))
    return sold.join(shuffled(customer), "unit_id").groupBy("district", "party").agg(F.sum("q").cast("long").alias("votes"))


cte("district_votes", """SELECT c_nationkey AS district, p_brand AS party, CAST(sum(l_quantity) AS BIGINT) AS votes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")


def magnitudes(spark, sf) -> DataFrame:
    """3 to 8 seats per nation."""
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("district"), (F.col("n_nationkey") % 6 + 3).alias("magnitude")
    )


cte("magnitudes", "SELECT n_nationkey AS district, n_nationkey % 6 + 3 AS magnitude FROM nation")


def _brand_number(col):
    return F.regexp_extract(col, r"\d+", 0).cast("int")


def pacts(spark, sf) -> DataFrame:
    """Pact of each brand in capital letters; every seventh brand has none."""
    brands = table(spark, sf, "part").select(F.upper("p_brand").alias("party")).distinct()
    number = _brand_number(F.col("party"))
    return brands.where(number % 7 != 0).withColumn("pact", F.concat(F.lit("P"), (number % 6).cast("string")))


cte("pacts", """SELECT DISTINCT p_brand AS party, 'P' || (CAST(regexp_extract(p_brand, '[0-9]+') AS INT) % 6) AS pact
FROM part WHERE CAST(regexp_extract(p_brand, '[0-9]+') AS INT) % 7 <> 0""")

cte("pact_votes", """SELECT district, party, votes, COALESCE(pact, party) AS pact
FROM district_votes LEFT JOIN pacts USING (party)""")


def type_pacts(spark, sf) -> DataFrame:
    """Part types grouped in two pacts by name length; some types stand alone."""
    kinds = table(spark, sf, "part").select(F.col("p_type").alias("party")).distinct()
    odd = F.length("party") % 3
    return kinds.where(odd != 2).withColumn("pact", F.concat(F.lit("T"), odd.cast("string")))


cte("type_pacts", """SELECT DISTINCT p_type AS party, 'T' || (length(p_type) % 3) AS pact FROM part
WHERE length(p_type) % 3 <> 2""")


def plans(spark, sf) -> DataFrame:
    """Eight plans of all customers, eight districts each."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("unit_id"))
    drawn = customer.withColumn("plan_id", F.explode(F.sequence(F.lit(0), F.lit(PLANS - 1))))
    u, p = F.col("unit_id"), F.col("plan_id")
    return drawn.select("plan_id", "unit_id", ((u * (2 * p + 1) + p) % DISTRICTS).cast("int").alias("district"))


cte("plans", """SELECT CAST(p AS INT) AS plan_id, c_custkey AS unit_id,
CAST((c_custkey * (2 * p + 1) + p) % 8 AS INT) AS district FROM customer, range(0, 8) t(p)""")


def plan_magnitudes(spark, sf) -> DataFrame:
    """Fixed seats of the eight plan districts."""
    return table(spark, sf, "customer").select((F.col("c_custkey") % 8).cast("int").alias("district")).distinct().withColumn(
        "magnitude", F.col("district") % 6 + 3
    )


cte("plan_magnitudes", """SELECT DISTINCT CAST(c_custkey % 8 AS INT) AS district,
CAST(c_custkey % 8 AS INT) % 6 + 3 AS magnitude FROM customer""")

cte("plan_votes", """SELECT plan_id, district, party, CAST(sum(votes) AS BIGINT) AS votes
FROM plans JOIN unit_votes USING (unit_id) GROUP BY ALL""")
cte("plan_population", """SELECT plan_id, district, CAST(sum(population) AS BIGINT) AS population
FROM plans JOIN population USING (unit_id) GROUP BY ALL""")


def district_population(spark, sf) -> DataFrame:
    """Orders per nation."""
    return unit_frame(spark, sf).groupBy(F.col("commune").alias("district")).agg(F.sum("population").alias("population"))


cte("district_population", """SELECT commune AS district, CAST(sum(population) AS BIGINT) AS population
FROM unit_frame GROUP BY 1""")


# ---- SQL generators shared by several oracles ----

def dhondt_sql(source: str, keys: str, threshold: str = "0", cap: str = "magnitude", out: str = "seats") -> str:
    """CTE ``out`` with the seats of every row of ``source`` (keys, party, votes, magnitude)."""
    return f"""{out}_t AS (SELECT *, GREATEST(votes, 0) AS v, sum(GREATEST(votes, 0)) OVER (PARTITION BY {keys}) AS tot
  FROM {source}),
{out}_q AS (SELECT *, unnest(range(1, CAST(LEAST({cap}, magnitude) AS BIGINT) + 1)) AS k FROM {out}_t
  WHERE tot > 0 AND magnitude > 0 AND v / CAST(tot AS DOUBLE) >= {threshold}),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys}
  ORDER BY v / CAST(k AS DOUBLE) DESC, v DESC, party DESC, k) AS rn FROM {out}_q),
{out}_w AS (SELECT {keys}, party, count(*) AS n FROM {out}_r WHERE rn <= magnitude GROUP BY ALL),
{out} AS (SELECT s.*, COALESCE(w.n, 0) AS seats FROM {source} s LEFT JOIN {out}_w w USING ({keys}, party))"""


def two_level_sql(source: str, keys: str, threshold: str = "0", cap: str = "magnitude", out: str = "seats") -> str:
    """CTE ``out``: two-level seats of ``source`` (keys, pact, party, votes, magnitude)."""
    return f"""{out}_l1 AS (SELECT {keys}, pact AS party, CAST(sum(GREATEST(votes, 0)) AS BIGINT) AS votes,
  max(magnitude) AS magnitude FROM {source} GROUP BY ALL),
{dhondt_sql(f"{out}_l1", keys, threshold, out=f"{out}_p")},
{out}_l2 AS (SELECT s.* EXCLUDE (magnitude), s.magnitude AS dm, p.seats AS magnitude
  FROM {source} s JOIN (SELECT {keys}, party AS pact, seats FROM {out}_p) p USING ({keys}, pact)),
{dhondt_sql(f"{out}_l2", f"{keys}, pact", cap=cap, out=f"{out}_i")},
{out} AS (SELECT * EXCLUDE (magnitude, dm), magnitude AS pact_seats, dm AS magnitude FROM {out}_i)"""


def shares_sql(source: str, keys: str, out: str = "shares") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""{out}_s AS (SELECT {head}party, sum(votes) AS votes, sum(seats) AS seats FROM {source} GROUP BY ALL),
{out} AS (SELECT {head}party, CAST(votes AS BIGINT) AS votes, CAST(seats AS BIGINT) AS seats,
  votes / NULLIF(sum(votes) OVER ({part}), 0)::DOUBLE AS vote_share,
  seats / NULLIF(sum(seats) OVER ({part}), 0)::DOUBLE AS seat_share FROM {out}_s)"""


def magnitude_sql(source: str, keys: str, total: int, lowest: int, highest: int, out: str = "mags") -> str:
    """CTE ``out``: seats by population of ``source`` (keys, district, population)."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""{out}_n AS (SELECT *, {total} - {lowest} * count(*) OVER ({part}) AS rest FROM {source}),
{out}_q AS (SELECT *, unnest(range({lowest + 1}, {highest + 1})) AS k FROM {out}_n),
{out}_r AS (SELECT *, row_number() OVER ({part} ORDER BY population / CAST(k AS DOUBLE) DESC, district, k) AS rn FROM {out}_q),
{out}_w AS (SELECT * EXCLUDE (k, rn, rest), {lowest} + count(*) FILTER (rn <= rest) AS magnitude FROM {out}_r GROUP BY ALL),
{out} AS (SELECT * REPLACE (CAST(magnitude AS INT) AS magnitude) FROM {out}_w)"""


# ---- geometry: customers as 1 km squares, 40 to a row, some far away ----

def unit_cells(spark, sf) -> DataFrame:
    """Grid cell of each customer; every 97th lies alone, far to the east."""
    u = F.col("unit_id")
    far = F.when(u % 97 == 5, 100).otherwise(0)
    return units(spark, sf).select("unit_id", "commune", "region", (u % 40 + far).alias("cx"), F.floor(u / 40).alias("cy"))


cte("unit_cells", """SELECT unit_id, commune, region, unit_id % 40 + CASE WHEN unit_id % 97 = 5 THEN 100 ELSE 0 END AS cx,
unit_id // 40 AS cy FROM units""")

_CORNERS = [(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (0, 2, 1.0, 1.0), (0, 3, 0.0, 1.0), (0, 4, 0.0, 0.0)]
_HOLE = [(1, 0, 0.25, 0.25), (1, 1, 0.75, 0.25), (1, 2, 0.75, 0.75), (1, 3, 0.25, 0.75), (1, 4, 0.25, 0.25)]


def vertices(spark, sf) -> DataFrame:
    """Square outlines in metres; every tenth customer has a square hole."""
    def corner(c):
        ring, seq, dx, dy = c
        return F.struct(F.lit(0).alias("part"), F.lit(ring).alias("ring"), F.lit(seq).alias("seq"),
                        ((F.col("cx") + dx) * 1000).alias("x"), ((F.col("cy") + dy) * 1000).alias("y"))

    outline, hole = F.array(*map(corner, _CORNERS)), F.array(*map(corner, _HOLE))
    rings = F.when(F.col("unit_id") % 10 == 3, F.concat(outline, hole)).otherwise(outline)
    return unit_cells(spark, sf).select("unit_id", "region", F.inline(rings))


cte("vertices", f"""SELECT unit_id, region, 0 AS part, ring, seq, (cx + dx) * 1e3 AS x, (cy + dy) * 1e3 AS y
FROM unit_cells, (VALUES {', '.join(map(str, _CORNERS + _HOLE))}) c(ring, seq, dx, dy) WHERE ring = 0 OR unit_id % 10 = 3""")


def edges(spark, sf) -> DataFrame:
    """Rook neighbours of the customer grid."""
    from hemicycle.operators.graph import adjacency

    return adjacency(vertices(spark, sf), "rook")


cte("edges", """SELECT a.unit_id AS src, b.unit_id AS dst FROM unit_cells a, unit_cells b
WHERE (b.cx = a.cx + 1 AND b.cy = a.cy) OR (b.cy = a.cy + 1 AND b.cx = a.cx)""".replace(
    "a.unit_id AS src, b.unit_id AS dst", "LEAST(a.unit_id, b.unit_id) AS src, GREATEST(a.unit_id, b.unit_id) AS dst"))


def shapes(spark, sf) -> DataFrame:
    """One outline per customer: rectangle, right triangle or L shape."""
    u = F.col("c_custkey")
    w, h = u % 7 + 1, u % 3 + 2
    kinds = {
        0: [(0, 0), (w, 0), (0, h), (0, 0)],
        1: [(0, 0), (w * 2, 0), (w * 2, h), (w, h), (w, h * 2), (0, h * 2), (0, 0)],
        2: [(0, 0), (w, 0), (w, h), (0, h), (0, 0)],
    }

    def ring(corners):
        return F.array(*[
            F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), F.lit(i).alias("seq"),
                     *[(F.lit(v) if isinstance(v, int) else v).cast("double").alias(n) for n, v in zip("xy", p)])
            for i, p in enumerate(corners)
        ])

    outline = F.when(u % 4 == 0, ring(kinds[0])).when(u % 4 == 1, ring(kinds[1])).otherwise(ring(kinds[2]))
    return table(spark, sf, "customer").select(u.alias("unit_id"), F.inline(outline))


cte("shapes", """SELECT c_custkey AS unit_id, c_custkey % 4 AS kind, CAST(c_custkey % 7 + 1 AS DOUBLE) AS w,
CAST(c_custkey % 3 + 2 AS DOUBLE) AS h FROM customer""")
cte("shape_measures", """SELECT unit_id, CASE kind WHEN 0 THEN w * h / 2 WHEN 1 THEN 3 * w * h ELSE w * h END AS area,
CASE kind WHEN 0 THEN w + h + sqrt(w * w + h * h) WHEN 1 THEN 4 * w + 4 * h ELSE 2 * w + 2 * h END AS perimeter,
CASE kind WHEN 0 THEN w * h / 2 WHEN 1 THEN 3.5e0 * w * h ELSE w * h END AS hull,
CASE kind WHEN 1 THEN sqrt(w * w + h * h) ELSE sqrt(w * w + h * h) / 2 END AS r FROM shapes""")
