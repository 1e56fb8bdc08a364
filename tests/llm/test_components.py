import os

from riskloom.llm import components as cc


def test_rounds_write_as_few_files_as_their_edges_ask_for(spark, frame, monkeypatch):
    files, kept = [], cc._kept

    def counted(df, purpose):
        out, folder = kept(df, purpose)
        if purpose == "stars":
            files.append(sum(f.endswith(".parquet") for f in os.listdir(folder)))
        return out, folder

    monkeypatch.setattr(cc, "_kept", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # Chains of four nodes and a hub.
        edges = frame([(4 * n + a, 4 * n + a + 1) for n in range(300) for a in range(3)]
                      + [(5000, 5000 + n) for n in range(1, 300)], "a long, b long")
        roots = {r.node: r.root for r in cc.components(edges).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert roots == {n: n - n % 4 for n in range(1200)} | {n: 5000 for n in range(5000, 5300)}
    assert files and max(files) <= spark.sparkContext.defaultParallelism
