import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from veridra.llm.merkle import folded, manifest_digest, merkle_manifest, proof_digest
from veridra.llm.queries import oracle_sql, queries

D = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, fan):
    """(root, siblings per node): level by level, as the definition says."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // fan * fan
            ways[i].append((nodes[run:k], nodes[k + 1 : run + fan]))
        nodes = [h("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        at = [k // fan for k in at]
    return nodes[0], ways


def plain(rows, fan=8):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[g] = (own, *climb([leaf_of(*r) for r in own], fan))
    root, tops = climb([trees[g][1] for g in names], fan)
    out = []
    for g, top in zip(names, tops):
        own, subroot, ways = trees[g]
        for r, way in zip(own, ways):
            doc_id, text, *rest = r
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
                text = text.translate(low)
            node, proof = leaf_of(doc_id, text, *rest), ""
            for left, right in way + top:
                node = h("".join(left) + node + "".join(right))
                proof += "".join(left + right)
            out.append((doc_id, leaf_of(*r), subroot, root, h(proof), node, node == root))
    return sorted(out, key=str)


def digest_rows(df, fan=8, levels=3):
    rows = merkle_manifest(df, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"text": changed()}, fan, levels)
    rows = rows.withColumn("f", folded(F.col("path"), F.col("claimed_leaf")))
    return sorted((tuple(r) for r in rows.select("id", "leaf", "subroot", "root", proof_digest(F.col("path")), "f", F.expr("f = root")).collect()), key=str)


def changed():
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, low).otherwise(F.col("text"))


def some(n, lang=lambda i: "en"):
    return [(i * 7 % n, f"Text {i}", lang(i), f"s{i % 3}", i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 73])
def test_trees_of_every_shape(spark, n):
    rows = some(n)
    assert digest_rows(spark.createDataFrame(rows, KIND).repartition(3)) == plain(rows)


def test_several_tiers_of_small_blocks(spark):
    rows = some(300, lambda i: None if i % 50 == 0 else f"l{i % 13}" if i % 2 else "hot")
    for fan, levels in ((2, 2), (3, 1)):
        assert digest_rows(spark.createDataFrame(rows, KIND).repartition(5), fan, levels) == plain(rows, fan)


def test_nulls_repeated_rows_clashing_names_and_long_texts(spark):
    rows = [(None, None, None, None, None)] * 3 + [(1, "A" * 300_000, "", "x", 1), (1, "b", "", "x", 1), (1, "b", "", "x", 1), (-5, "É[", "de", None, 2), (6, "", "é", "x", 0), (6, "", "z", "x", 0)]
    wide = spark.createDataFrame([(*r, "a", 9, "b") for r in rows], KIND + ", hash string, _g int, PATH string")
    assert digest_rows(wide) == plain(rows)
    got = manifest_digest(wide)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_an_empty_table_gives_no_rows(spark):
    assert manifest_digest(spark.createDataFrame([], KIND)).collect() == []


def test_levels_of_a_block_are_grouped_without_another_shuffle(spark):
    from veridra.llm import merkle

    nodes = spark.range(5000).selectExpr("concat('+', id % 3) AS _g", "id AS _rank", "5000L AS _n", "sha2(cast(id AS string), 256) AS hash")
    plan = merkle._roll(nodes, [], 8, 3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange ") == 1


def test_the_query_equals_its_sql_and_plain_python(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    want = con.sql(oracle_sql()["op12_merkle_manifest"])
    got = sorted((tuple(r) for r in queries()["op12_merkle_manifest"](spark, D).select(*want.columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert got == plain(rows)
