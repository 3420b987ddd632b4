import random
import zlib

import corpus_pipeline
from gridlode.llm.storage import written


def texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    line = lambda n=14: " ".join(word() for _ in range(n))
    docs = [[line() for _ in range(6)] for _ in range(120)]
    toxic = [i for i in range(1, 120) if i % 4 == 1]
    for i in toxic:
        docs[i][2] += rng.choice([" vile", " rotten"])
    item = line(16)
    docs[6][3] = "so " + item + " it goes"
    repeated = line(60)
    docs[8][1] = docs[10][1] = docs[12][4] = repeated
    rows = [(i, "\n".join(d)) for i, d in enumerate(docs)]
    copied = docs[20][0].split(" ")
    rows.append((500, "\n".join(docs[20])))
    rows.append((501, " ".join([*(w for d in docs[24] for w in d.split(" ")), "more"])))
    rows.append((502, None))
    return rows, toxic, item, repeated, copied


def test_stages(spark, tmp_path):
    rows, toxic, item, repeated, _ = texts()
    sf_dir = str(tmp_path)
    full = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    seen, now = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, sf_dir), name)
        if name != "mixing":
            assert now.columns == docs.columns
        seen[name] = {r.doc_id: r for r in now.collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((i in seen["toxicity"]) == (i not in toxic) for i in held)
    lines = seen["line dedup"]
    assert set(lines) == set(seen["toxicity"])
    assert repeated in lines[8].text and repeated not in lines[10].text and repeated not in lines[12].text
    assert lines[500].text == "" and lines[500].n_chars == 0 and lines[20].text == dict(rows)[20]
    near = seen["near dedup"]
    assert 24 in near and 501 not in near and set(lines) - set(near) == {501}
    assert set(near) - set(seen["decontamination"]) == {6}
    mixed = seen["mixing"]
    assert set(mixed) <= set(near) - {6, 500, 502} and all(0 < r.taken <= 2 * r.size for r in mixed.values())
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.taken) for r in run) == sorted((r.doc_id, r.taken) for r in mixed.values())
