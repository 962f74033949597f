import sentencepiece

import corpus_pipeline
from screenflow.llm.decontamination import Automaton, words
from screenflow.llm.language import Classifier, counted, held_out, most_frequent
from screenflow.llm.pii import find_spans, redact
from screenflow.llm.simhash import fingerprint, shingle_hashes

FOLDER = "/root/testdata/sf0.001"


def plain(docs, items, library):
    """The five stages one after the other, in plain loops over all rows."""
    taught = {}
    for r in docs:
        if not r["held"] and r["text"] is not None and r["lang"] is not None:
            taught.setdefault(r["lang"], []).append(r["text"])
    profiles = [(lang, i, int(k)) for lang, texts in taught.items() for i, k in enumerate(most_frequent(*counted(" ".join(texts)), 300))]
    model = Classifier(profiles, 300)
    kept = [r for r in docs if (p := model.predict(r["text"]))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE]
    prints = [fingerprint(shingle_hashes(r["text"])) for r in kept]
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    first = {}
    for r, x in zip(kept, label):
        if x not in first or r["doc_id"] < first[x]["doc_id"]:
            first[x] = r
    automaton = Automaton(items, 10)
    clean = [r for r in first.values() if not automaton.scan(words(r["text"]))[0]]
    out = {}
    for r in clean:
        text = redact(r["text"], find_spans(r["text"]))
        out[r["doc_id"]] = (text, r["lang"], r["source"], len(text), library.encode(text, add_eos=True))
    return out


def test_run_is_the_plain_version(spark, model_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("held", held_out()).collect()
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    wanted = plain(docs, items, sentencepiece.SentencePieceProcessor(model_file=model_path))
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["text"], r["lang"], r["source"], r["n_chars"], r["piece_ids"]) for r in rows} == wanted
    assert len(rows) == len(wanted) < len(docs) and all(r["exact"] for r in rows)


def test_stages_keep_the_columns(spark, documents, no_documents):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (documents, no_documents):
            docs = docs.withColumn("n_chars", docs["doc_id"])
            out = stage(spark, docs, FOLDER)
            assert name == "encode" or out.columns == docs.columns
            out.count()
