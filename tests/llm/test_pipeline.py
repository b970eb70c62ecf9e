"""The pipeline's stages and run() on a small table, against brute force."""

import re
from collections import defaultdict

import corpus_pipeline
from lintel.llm import packing, toxicity
from lintel.llm.common import materialise

FOLDER = "/root/testdata/sf0.001"
KINDS = [(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({x: x + 32 for x in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def without_near_copies(rows):
    sets, out = {i: shingles(t) for i, t in rows.items()}, dict(rows)
    seen = set()
    for i in sorted(rows):
        if i in seen or not sets[i]:
            continue
        todo = [i]
        seen.add(i)
        while todo:
            a = todo.pop()
            for b in sets:
                if b not in seen and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    seen.add(b), todo.append(b), out.pop(b)
    return out


def packed(rows):
    """Bytes of token ids by document, after a look at places and lengths."""
    ids, bins = defaultdict(bytes), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert len(r["ids"]) == 4 * r["length"]
        ids[r["doc_id"]] += bytes(r["ids"])
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return dict(ids)


def test_stages_and_run_against_brute_force(spark):
    import numpy as np
    from tokenizers import Tokenizer

    docs, made = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made[name] = docs = materialise(stage(spark, docs, FOLDER), name)
    first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(first, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("predicted = 1").collect()}
    want = {i: t for i, t in texts(first).items() if i not in toxic}
    assert texts(made["toxicity"]) == want

    want = without_near_copies(want)
    assert texts(made["near_duplicates"]) == want and made["near_duplicates"].count() == len(want)

    items = [s for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() if (s := shingles(r["text"]))]
    want = {i: t for i, t in want.items() if not any(100 * len(s & shingles(t)) >= 80 * len(s) for s in items)}
    assert texts(made["decontamination"]) == want

    clean = texts(made["secret_scan"])
    assert clean.keys() == want.keys()
    for t in clean.values():
        assert not any(len(m.group(g)) >= least for p, g, least in KINDS for m in re.finditer(p, t or "", re.A))

    exact = Tokenizer.from_file(packing.public_tokenizer("byte_bpe_50k.json"))
    tokens = {i: np.array(exact.encode(t or "", add_special_tokens=False).ids + [packing.END_OF_DOCUMENT], "<u4").tobytes() for i, t in clean.items()}
    assert packed(made["packing"].collect()) == tokens
    assert packed(corpus_pipeline.run(spark, FOLDER).collect()) == tokens
