import re

from pyspark.sql import functions as F

from riskloom.operators import generate as gen


def test_same_seed_same_messages(spark):
    one = gen.generate_messages(spark, 300, 5)
    ids = spark.range(300).repartition(7)
    two = gen.generate_for(ids, "id", 5).select("type", "message").distinct()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one.exceptAll(gen.generate_messages(spark, 300, 6)).count() > 250


def test_shapes(spark):
    drafts = [r.m for r in gen.with_draws(spark.range(600), "id", 42).select(gen.template_text().alias("m")).collect()]
    assert any(re.match(r"^\[.+\] \w+: \w+ [\w ]+ of \$\d{3}\. [\w ]+ \w+: \S+$", d) for d in drafts)
    assert any(re.match(r"^[\w ]+: \$\d{3} \w+ from Account \*{4}\d{4}\. \w+ \S+$", d) for d in drafts)
    assert any(re.match(r"^\w+: Package ##\d{6} requires [\w ]+\. [\w ]+ \S+$", d) for d in drafts)
    assert not any("{" in d for d in drafts)


def test_links(spark):
    links = [r.l for r in gen.with_draws(spark.range(900), "id", 42).select(gen.link().alias("l")).collect()]
    kinds = [r"^(https?://)?\w+\[\.\](com|net|org|info)$", r"^[a-z0-9]+\.(com|net)$",
             r"^\w+-redirect\.(com|net)(\?id=[0-9a-f-]{36})?$"]
    counts = [sum(bool(re.match(k, link)) for link in links) for k in kinds]
    assert sum(counts) == 900 and min(counts) > 230


def test_rates(spark):
    rows = gen.with_draws(spark.range(4000), "id", 42).withColumn("m", F.lit("pay 12: now please"))
    out = [r.m for r in gen.noise(gen.rewrites(rows, "m"), "m").collect()]
    share = lambda test: sum(map(test, out)) / len(out)
    assert abs(share(lambda m: "$" in m) - 0.5) < 0.05
    assert abs(share(lambda m: "  " in m) - 0.2) < 0.04
    assert abs(share(lambda m: m[:3] == "PAY") - 0.1) < 0.03
    assert not any(":" in m for m in out)
