"""A saved head through `score_with`: same logits as the plain forward pass, versions told apart."""

import numpy as np
from pyspark.sql import functions as F

from inkgauge.operators import models
from inkgauge.session import work_path
from inkgauge.sources import sinks


def test_saved_head(spark):
    rng = np.random.default_rng(3)
    heads = [models.MlpHead([(rng.standard_normal((4, 3)), rng.standard_normal(3)), (rng.standard_normal((3, 2)), np.zeros(2))]) for _ in (0, 1)]
    rows = [(i, rng.standard_normal(4).tolist() if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = set()
    for head in heads:
        path = work_path(spark, "head")
        sinks.save_head(head, spark, path)
        again = sinks.load_head(spark, path)
        assert models.head_digest(again) == models.head_digest(head)
        out = models.score_with(df, models.head_loader(spark, again, "vec_id"), df.columns, "vec_id long, z0 double, z1 double, model string", 7)
        plain = {r.vec_id: r.logits for r in models.mlp_head_forward(df, head, F.col("embedding")).collect()}
        found = out.collect()
        assert {r.vec_id: None if r.z0 is None else [r.z0, r.z1] for r in found} == plain
        assert {r.model for r in found} == {models.head_digest(head)}
        seen |= {r.model for r in found}
    assert len(seen) == 2
