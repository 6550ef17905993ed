"""Components against a plain search, and how often they write to the shared folder."""

import random

import pytest

from mensura.llm import components as module
from mensura.llm.common import TASK_ROWS, tasks_for
from mensura.llm.components import components


@pytest.fixture()
def written(monkeypatch):
    """Names of the frames that components write."""
    names, real = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: names.append(name) or real(df, name))
    return names


def plain(links):
    above = {n: n for a, b in links if a is not None and b is not None and a != b for n in (a, b)}
    for _ in above:
        for a, b in links:
            if a in above and b in above:
                above[a] = above[b] = min(above[a], above[b])
    return above


def frame(spark, links):
    return spark.createDataFrame(links, "a long, b long")


def test_stars_take_no_round(spark, written):
    links = [(-5, k) for k in range(12)] + [(k, 20) for k in range(21, 30)] + [(21, 20), (40, 40), (None, 3), (3, None)]
    assert {r.node: r.root for r in components(frame(spark, links)).collect()} == plain(links)
    assert written == ["links"]


def test_further_links_go_on_from_a_result(spark, written):
    rng = random.Random(8)
    links = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(30)]
    further = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(25)] + [(9, 9)]
    done = components(frame(spark, links))
    assert sorted(map(tuple, done.collect())) == sorted(plain(links).items())
    both = components(done.toDF("a", "b").union(frame(spark, further)))
    assert sorted(map(tuple, both.collect())) == sorted(plain(links + further).items())
    written.clear()
    assert sorted(map(tuple, components(both.toDF("a", "b")).collect())) == sorted(plain(links + further).items())
    assert written == ["links"]
    assert components(frame(spark, [])).count() == 0


@pytest.fixture()
def many_partitions(spark):
    """More shuffle partitions than the rows need, and none of them merged."""
    settings = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def files_of(monkeypatch, *modules):
    """(name, files) of each frame that ``modules`` write."""
    found, real = [], module.stored

    def note(df, name):
        out = real(df, name)
        found.append((name, len(out.inputFiles())))
        return out

    for m in modules:
        monkeypatch.setattr(m, "stored", note)
    return found


def test_tasks_bound_the_files_of_every_round(spark, many_partitions, monkeypatch):
    found = files_of(monkeypatch, module)
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    assert {r.node: r.root for r in components(frame(spark, links), 3).collect()} == plain(links)
    assert len(found) >= 5 and max(files for _, files in found) <= 3


def test_few_sets_take_few_tasks_whatever_the_shuffle_partitions(spark, many_partitions, monkeypatch):
    from mensura.llm import jaccard

    found = files_of(monkeypatch, module, jaccard)
    rows = [(k, " ".join(f"w{k // 4}x{i}" for i in range(40 + k % 4)) + f" e{k}") for k in range(300)]
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: k // 4 * 4 for k in range(300)}
    late = [files for name, files in found if name not in ("sets", "nodes", "shared", "texts")]
    assert len(late) >= 20 and max(late) <= spark.sparkContext.defaultParallelism


def test_tasks_grow_with_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [tasks_for(spark, n) for n in (0, TASK_ROWS, 100 * TASK_ROWS, 100 * TASK_ROWS + 1)] == [cores, cores, 100, 101]
