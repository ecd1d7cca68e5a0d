"""Few links in very many parts need no steps between the parts."""

import numpy as np

from thriftlens.llm import ann, common


def test_few_links_in_many_parts_are_stars_at_once(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "v long, u long").repartition(16)
    out = common.contracted(links)
    assert sorted(map(tuple, out.select("u", "v").collect())) == [(i, 0) for i in range(1, 61)]
    assert common.contracted(links, chunk=10).count() >= 60


def test_all_curves_are_used_whatever_the_data(spark):
    x = np.random.default_rng(3).normal(size=(60, 8))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, v array<double>")
    used, width = ann.fit_window(points, ann.fit_curves(ann.unit(x), 6, 8, 3), {0: [1, 2], 3: [4]}, 60, 0.97, True)
    assert used == 6 and 1 <= width <= 60
