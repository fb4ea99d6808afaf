import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.merkle import folded, hex_text, leaf, placed, proof_digest, proofs, slots

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row[:5]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grown(nodes, fanout):
    """The root over nodes, and what stands left and right of every leaf's ancestors."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            begin = i - i % fanout
            run = nodes[begin : begin + fanout]
            steps[k].append(("".join(run[: i - begin]), "".join(run[i - begin + 1 :])))
        at = [i // fanout for i in at]
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], steps


def expected(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for name in names:
        keyed = sorted(((r[0] is not None, r[0] or 0, leaf_of(r), r) for r in groups[name]), key=lambda k: k[:3])
        trees.append((keyed, *grown([k[2] for k in keyed], fanout)))
    root, tops = grown([t[1] for t in trees], fanout)
    return sorted(
        (str(k[3][0]), k[2], subroot, root, *map(list, zip(*(steps + top), strict=True)))
        if steps + top
        else (str(k[3][0]), k[2], subroot, root, [], [])
        for (keyed, subroot, paths), top in zip(trees, tops, strict=True)
        for k, steps in zip(keyed, paths, strict=True)
    )


def found(manifest):
    sides = [F.transform(f"proof.{side}", hex_text).alias(side) for side in ("left", "right")]
    got = manifest.select(F.col("id").cast("string"), "leaf", "subroot", "root", *sides).collect()
    return sorted((str(r[0]), *r[1:]) for r in got)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_edge_rows_against_plain_python(edge, edge_rows, fanout):
    want = expected(edge_rows, fanout)
    assert found(proofs(edge, COLUMNS, fanout=fanout)) == want


def test_roots_do_not_depend_on_the_order_of_the_input(spark, documents):
    some = [tuple(r) for r in documents.limit(60).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    df = spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(proofs(df.orderBy(F.desc("text")).repartition(5), COLUMNS)) == expected(some)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9])
def test_sizes_of_trees(spark, n):
    rows = [(k, f"t{k}", "x", "s", k) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(proofs(df, COLUMNS)) == (expected(rows) if n else [])


def test_many_groups_of_one_row(spark):
    rows = [(k, f"t{k}", f"g{k}", "s", k) for k in range(11)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert found(proofs(df, COLUMNS)) == expected(rows)


def test_places_number_the_rows_of_each_group(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise("a").alias("g"))
    got = placed(df.repartition(6), "g", ["id"]).collect()
    for rest, size in ((True, 334), (False, 666)):
        mine = sorted((r.id, r.place, r.size) for r in got if (r.id % 3 == 0) == rest)
        assert [p for _, p, _ in mine] == list(range(size)) and {s for *_, s in mine} == {size}
        assert len({r.tree for r in got if (r.id % 3 == 0) == rest}) == 1
    assert len({r.tree for r in got}) == 2


def test_a_changed_row_is_found_by_its_proof(spark, edge):
    made = proofs(edge, COLUMNS, keep={"other": leaf([F.col("doc_id"), F.lit("elsewhere")])})
    ok, bad = folded(F.col("leaf"), F.col("proof")), folded(F.col("other"), F.col("proof"))
    assert made.filter(ok != F.col("root")).count() == 0 and made.filter(bad == F.col("root")).count() == 0
    assert {len(r[0]) for r in made.select(proof_digest(F.col("proof"))).collect()} == {64}


def test_siblings_are_the_other_slots_of_a_run(spark):
    for fanout in (2, 3, 4):
        got = spark.range(12).select("id", F.col("id").alias("place")).select("id", *slots(fanout)).collect()
        for r in got:
            run = r[0] - r[0] % fanout
            assert sorted(r[1:]) == [p for p in range(run, run + fanout) if p != r[0]]
