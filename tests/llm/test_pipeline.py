import collections

import pandas as pd
import public_tokenizers as P
from test_llm import SF, classes_by_definition, plain_base

import corpus_pipeline
from tidelog.llm import bpe, langid, mixing, pii


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id", drop=False)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "personal_data", "mix_sources", "byte_bpe"]

    one = stages["language_id"](spark, docs, SF)
    model = langid.learn(docs)
    _, _, _, rejected = model.predict(rows.text.tolist())
    ids = set(rows.doc_id[~rejected])
    assert one.columns == docs.columns and {r.doc_id for r in one.select("doc_id").collect()} == ids

    two = stages["near_duplicates"](spark, one, SF)
    ids = set(classes_by_definition([(d, rows.text[d]) for d in sorted(ids)]).values())
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == sorted(ids)

    three = stages["personal_data"](spark, two, SF)
    texts = {d: pii.redact(rows.text[d], pii.find(rows.text[d], pii.trained())[1]) for d in ids}
    got = three.collect()
    assert three.columns == docs.columns and {r.doc_id: r.text for r in got} == texts and all(r.n_chars == len(r.text) for r in got)
    assert all(not any(plain_base(t).values()) for t in texts.values())

    four = stages["mix_sources"](spark, three, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(three).collect() if r.copies}
    assert four.columns == docs.columns and collections.Counter(r.doc_id for r in four.collect()) == copies

    five = stages["byte_bpe"](spark, four, SF).collect()
    assert len(five) == sum(copies.values())
    assert all(bpe.decode_ids(r.ids, P.path("byte_bpe_50k.tiktoken")).decode() == texts[r.doc_id] for r in five)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names: what each stage keeps, and that reruns agree."""
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    langs = [r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [(i, t, x, "a" if i % 3 else None, len(t), "x", i, "y") for i, (t, x) in enumerate(zip(real, langs, strict=True))]
    rows += [(100, None, "en", "a", 0, "x", 1, None), (101, "", "en", "a", 0, "x", 1, None), (102, "123 ?!", None, None, None, None, None, None)]
    rows += [(None, real[1], "en", "a", 5, "x", 1, "y"), (None, real[1], "en", "a", 5, "x", 1, "y"), (3, real[3], langs[3], "a", 7, "x", 3, "y"), (4, real[5], None, None, None, None, 4, None)]
    rows += [(103, " ".join(real * 12), None, "b", 1, None, 1, "y"), (104, real[2], langs[2], "b", 1, None, 1, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, size long, __row string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, stage(spark, now.repartition(3), str(tmp_path)).collect()))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = collections.Counter(r.doc_id for r in now.collect())
        assert stage(spark, now.limit(0), str(tmp_path)).count() == 0
    assert not {100, 101, 102} & set(kept["language_id"]) and kept["language_id"][None] == 2 and kept["language_id"][3] == 2
    near = kept["near_duplicates"]
    assert near[None] == 2 and max(n for d, n in near.items() if d is not None) == 1 and 104 not in near and kept["personal_data"] == near
    last = dict(corpus_pipeline.STAGES)["byte_bpe"]
    assert last(spark, now, SF).count() == now.count() and last(spark, now.limit(0), SF).count() == 0
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert collections.Counter(r.doc_id for r in done.collect()) == kept["mix_sources"]


def test_run_leaves_one_folder(spark):
    import os

    from tidelog.llm.common import shared_dir

    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    done = corpus_pipeline.run(spark, SF)
    (new,) = {n for n in os.listdir(root) if n not in before and not n.startswith("broker-")}
    assert os.listdir(f"{root}/{new}") == ["4-byte_bpe"] and done.count() > 0


def test_stages_give_freed_native_memory_back(spark):
    """Native memory that the driver's JVM has freed between blocks still in use goes back to the system with the next stage, and with the next saved table."""
    import re
    from pathlib import Path

    from tidelog.llm.common import saved

    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    dict(corpus_pipeline.STAGES)["personal_data"](spark, docs, SF)  # what both do at first has been done
    saved(docs)

    def freed_by(what):
        blocks = [jvm.java.nio.ByteBuffer.allocateDirect(60_000) for _ in range(3000)]
        for i, x in enumerate(blocks):
            if i % 100 != 99:
                jvm.org.apache.spark.storage.StorageUtils.dispose(x)
        before = held()
        what()
        after = held()
        for x in blocks[99::100]:
            jvm.org.apache.spark.storage.StorageUtils.dispose(x)
        return before - after

    assert freed_by(lambda: dict(corpus_pipeline.STAGES)["personal_data"](spark, docs, SF)) > 80
    assert freed_by(lambda: saved(docs)) > 80
