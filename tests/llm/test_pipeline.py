import corpus_pipeline
from crestline.llm import exact_dedup, near_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert out.count() <= docs.count()
        docs = out
        names.append(name)
    assert names == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup"]
    assert exact_dedup.exact_dedup(docs).where("group_size > 1 AND text_sha256 <> sha2('', 256)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_near_stage_leaves_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = near_dedup.drop_near_copies(docs)
    assert near_dedup.near_groups(kept).where("NOT kept").count() == 0
    assert toxicity.OrdinalModel({}, (50.0,)).at_least("x")[0] < 0.5


def test_near_stage_links_from_four_fifths_on(spark):
    rows, gone = [], set()
    for k in range(30):
        words = [f"b{k}w{j}" for j in range(120)]
        changed = 10 + k % 5  # similarities 0.841, 0.827, 0.813, 0.798 and 0.785
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-changed] + [f"c{k}w{j}" for j in range(changed)]))]
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows[-2:])
        if 100 * len(a & b) >= 80 * len(a | b):
            gone.add(2 * k + 1)
    assert len(gone) == 18
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == set(range(60)) - gone
    assert near_dedup.drop_near_copies(docs).count() == 60


def test_stages_take_odd_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names and an empty table."""
    long_text = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, "a b c d e f g", None, 7, "x", 1, b"z"), (2, None, "en", None, None, None, None), (3, "", None, 0, "y", 2, None), (3, "", None, 0, "y", 2, None)]
    rows += [(None, "no id here", "s", 10, None, None, None), (4, long_text, "s", 1, "w", 3, b""), (5, long_text + " more", "s", 2, "w", 3, b""), (1, "another text of one", None, 7, "x", 1, b"z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, component string, n_removed int, kept_bytes binary")
    want = {"toxicity": 8, "exact_dedup": 6, "near_dedup": 7, "substring_dedup": 8}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "packing":
            assert out.groupBy("doc_id").count().count() == 6
        else:
            assert out.columns == docs.columns and out.count() == want[name], name
            assert {tuple(r) for r in out.where("doc_id < 4").collect()} <= {tuple(r) for r in rows}
