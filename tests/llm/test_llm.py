"""The operators for training data: brute force, SQL, round trips, held-out accuracy, and odd inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lintel.llm import decontaminate, jaccard_join, language_id, media, packing, quality, queries, secrets, toxicity, url_filter, warc_revisit

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row long, item string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, "clash", 7, "x") for i, t in rows], SCHEMA)


ODD = [(None, None), (1, None), (2, ""), (3, "a b c d e f g h"), (3, "a b c d e f g h"), (4, "A b\tc d\ne f g h"), (5, "x " * 200_000), (6, "été 漢字 " * 3), (7, "..."), (8, "w" * 300_000)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for n in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{FOLDER}/{n}.parquet')")
    got = queries.queries()[name](spark, FOLDER)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(map(str, r))
    assert want and sorted(map(key, got.collect())) == sorted(map(key, want))


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({x: x + 32 for x in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, k, percent):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, t) for i, t in enumerate(["", "a", "a", "a b", "A B"])]
    for i in range(60):  # near copies of one text, some of them too far from it and near each other only
        w = list(base)
        for j in range(i % 7):
            w[(i // 7 * 11 + j * 5) % 120] = f"e{i // 14}-{j}"
        rows.append((100 + i, " ".join(w)))
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id >= 0").selectExpr("doc_id + 1000 as doc_id", "text").collect()]
    want = brute_components(rows, k, percent)
    got = jaccard_join.jaccard_components(docs(spark, rows), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    common = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    signer = jaccard_join.Signer(percent, common)
    for _ in range(1500):
        n = int(rng.integers(1, 30) if rng.random() < 0.5 else rng.integers(30, 400))
        a = np.unique(np.concatenate((rng.integers(0, 2**63, n, dtype=np.uint64), rng.choice(common, n // 3))))
        gone = int(rng.integers(0, len(a) // 4 + 1))
        fresh = int(rng.integers(0, len(a) // 4 + 2))
        b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2**63, fresh, dtype=np.uint64))))
        same = len(np.intersect1d(a, b))
        if len(b) and not np.array_equal(a, b) and 100 * same >= percent * (len(a) + len(b) - same):
            assert len(np.intersect1d(signer.of(a), signer.of(b))), (len(a), len(b), same)
        x, y = jaccard_join.sketch_of(a), jaccard_join.sketch_of(b) if len(b) else b"\0" * 16
        size = min(len(x), len(y))
        assert np.bitwise_count(jaccard_join.folded(x, size) ^ jaccard_join.folded(y, size)).sum() <= len(a) + len(b) - 2 * same


def test_bands_enumerate_subsets():
    lows = jaccard_join.bands(80)
    plans = [jaccard_join.band_plan(i, lows, 80) for i in range(len(lows) - 1) if lows[i] < 10_000]
    assert all(p.n2 > 2 and len(p.subsets) > p.n2 - p.k2 for p in plans if p) and sum(p is None for p in plans) < 6


def test_large_mixed_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "FLUSH", 500)
    test_jaccard_against_brute_force(spark, 5, 80)


def test_join_leaves_only_what_its_result_reads(spark):
    import os

    folder = jaccard_join.Scratch(spark).folder
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    jaccard_join.jaccard_components(docs(spark, [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k")]))
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"sizes", "classes", "placed"}


def test_secrets_against_brute_force(spark):
    kinds = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
    texts = ["é token = 'abcdefghijkl' x", "secret=token:password=longvalue1234 AKIA" + "Q" * 16, "AKIAQ deadbeefdeadbeef0 cafe", "PASSWORD: short", "apikey=" + "0f" * 20 + "\n" + "0f" * 9]
    rows = [*enumerate(texts, 50), *[x for x in ODD if x[0] not in (3, None)]]
    got = {r["doc_id"]: r["secrets"] for r in secrets.find_secrets(docs(spark, rows)).collect()}
    for i, t in rows:
        want = sorted((m.start(), k, m.end(), n) for k, (n, p, g, least) in enumerate(kinds) for m in re.finditer(p, t or "", re.A) if len(m.group(g)) >= least)
        assert [tuple(s) for s in got[i] if s["kind"] != "random"] == want, t
    clean = secrets.redact(docs(spark, rows)).where("doc_id = 50").first()
    assert clean["text"] == "é [SECRET]' x" and clean["n_chars"] == len(clean["text"])


def test_very_many_secrets_in_one_text(spark):
    n = 30_000
    text = " ".join(f"{i:020x}é" for i in range(n)) + " password = " + "q" * 300
    got = secrets.redact(docs(spark, [(1, text), (2, None), (3, "")])).select("doc_id", "text", "n_chars", "score").collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: " ".join(["[SECRET]é"] * n) + " [SECRET]", 2: None, 3: ""}
    assert {r["n_chars"] for r in got if r["doc_id"] == 1} == {n * 10 + 8} and {r["score"] for r in got} == {"clash"}


def battery_in_python(t):
    """(band, score, runs_z, serial_z) of a token, from the definitions."""
    letters = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", t) else 32 if re.fullmatch("[A-Z2-7]+", t) else 36 if re.fullmatch("[0-9a-z]+|[0-9A-Z]+", t) else 64
    t = t.lower() if letters < 64 else t
    n, v = len(t), [secrets.ALPHABET.index(c) + 1 for c in t]
    chi = sum(t.count(c) ** 2 for c in set(t)) * letters / n - n
    mean, above = sum(v) / n, sum(x > letters / 2 for x in v)
    runs = 1 + sum((a > letters / 2) != (b > letters / 2) for a, b in zip(v, v[1:]))
    expected = 2 * above * (n - above) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    variance = sum((x - mean) ** 2 for x in v)
    serial = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:]))
    band = min(max(n.bit_length() - 5, 0), secrets.BANDS - 1)
    return band, (chi - (letters - 1)) / (2 * (letters - 1)) ** 0.5, (runs - expected) / spread**0.5 if spread > 0 else 99, serial / variance * n**0.5 if variance > 0 else 99


def test_battery_and_cut_against_brute_force(spark):
    import random
    from statistics import mean, stdev

    rng, scores = random.Random(9), {}
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", secrets.ALPHABET]
    tokens = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (20, 31, 32, 64, 200, 3000)] + ["ab1" * 20, "a1" + "b" * 40, "x" * 30 + "7"]
    df = spark.createDataFrame([(t,) for t in tokens], "token string").select("token", secrets.battery(F.col("token")).alias("b")).select("token", "b.*")
    for r in df.collect():
        assert tuple(r)[1:] == pytest.approx(battery_in_python(r["token"]), rel=1e-6, abs=1e-6), r["token"]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice((18, 20, 24, 40)))) for _ in range(300)]
    tokens = [t for t in tokens if re.search("[0-9]", t) and re.search("[A-Za-z]", t) and len(t) >= 20]
    got = secrets.thresholds(docs(spark, [(i, f"see {t} .") for i, t in enumerate(words + tokens)]))
    for t in words:
        b, score, *_ = battery_in_python(t)
        scores.setdefault(b, []).append(score)
    null = {b: (mean(x), stdev(x)) for b, x in scores.items() if len(x) >= 30}
    null = [null.get(b, secrets.WORD_SCORE) for b in range(secrets.BANDS)]
    normal = lambda z: 1 / (1 + np.exp(min(600.0, -(1.5976 * z + 0.07056 * z**3))))
    ps = []
    for t in tokens:
        b, score, runs, serial = battery_in_python(t)
        ok = score <= secrets.REJECT and abs(runs) <= secrets.REJECT and abs(serial) <= secrets.REJECT
        ps.append(normal((score - null[b][0]) / null[b][1]) if ok else 1.0)
    step = secrets.MOST / secrets.BINS
    bins = [min(secrets.BINS - 1, int(-np.log10(p) / step)) if p > 0 else secrets.BINS - 1 for p in ps]
    cuts = [10 ** (-b * step) for b in set(bins) if b and 10 ** (-b * step) <= secrets.FALSE_SHARE * sum(x >= b for x in bins) / len(bins)]
    z = np.array([(limit - m) / s for limit, (m, s) in zip(got, null)])
    assert cuts and np.allclose([normal(x) for x in z], max(cuts), rtol=1e-4)


def test_random_tokens_are_found(spark):
    import random

    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choice(letters) for _ in range(44)) for _ in range(40)]
    plain = [(1000 + i, "internationalisations of the " + "antidisestablishmentarianism" * 2) for i in range(100)]
    got = secrets.find_secrets(docs(spark, [(i, f"see {t} there") for i, t in enumerate(tokens)] + plain)).collect()
    assert sum(any(s["kind"] == "random" for s in r["secrets"]) for r in got if r["doc_id"] < 1000) >= 30
    assert not any(r["secrets"] for r in got if r["doc_id"] >= 1000)


def test_packing_is_whole(spark):
    got = packing.pack_documents(docs(spark, ODD), with_ids=True).toPandas()
    assert (got["ids"].map(zlib.crc32) == got["ids_crc32"]).all() and (got["ids"].map(len) == 4 * got["length"]).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 2048 and list(s["offset"]) == [0, *s["length"].cumsum()[:-1]]
    assert len(got[got["piece"] == 0]) == len(ODD) and (got[got["piece"] > 0]["length"] == 2048).all()


def test_the_two_tokenisers_agree(spark):
    fast, exact, marks = packing._tokenisers(packing.public_tokenizer("byte_bpe_50k.json"), packing.public_tokenizer("byte_bpe_50k.tiktoken"))
    assert marks
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").limit(300).collect():
        assert fast.encode_ordinary(r[0]) == exact.encode(r[0], add_special_tokens=False).ids


def test_ids_are_those_of_the_vocabulary(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.public_tokenizer("byte_bpe_50k.json"))
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "<|endoftext"), (4, "漢字 <|endoftext|>"), (5, "été"), (6, "one"), (6, "one")]
    got = packing.pack_documents(docs(spark, rows), with_ids=True).collect()
    want = sorted(b"".join(x.to_bytes(4, "little") for x in [*exact.encode(t, add_special_tokens=False).ids, 0]) for _, t in rows)
    assert sorted(bytes(r["ids"]) for r in got) == want


def triplets(n, seed):
    """Lengths of pieces that fill n bins of 1000 with three pieces each."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2))
        out += [a, b, 1000 - a - b]
    return out


def test_the_genetic_algorithm_beats_best_fit_decreasing(spark):
    lengths = triplets(30, 4)
    plain = packing.Packing(lengths, 1000, [])
    plain.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]))
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = packing.pack_items(items, 1000).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], lengths[r["item"]]))
    assert len(got) == len(lengths) == len({r["item"] for r in got}) and 30 <= len(bins) < len(plain.bins)
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 1000


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 900, 400).tolist()
    parents = []
    for _ in range(2):
        parents.append(packing.Packing(lengths, 1000, []))
        parents[-1].best_fit(rng.permutation(400).tolist())
    child = packing.crossover(*parents, rng)
    assert sorted(p for b in child.bins for p in b) == list(range(400)) and max(child.fills) <= 1000
    assert child.fills == [sum(lengths[p] for p in b) for b in child.bins] and len(child.bins) <= max(len(p.bins) for p in parents)
    _, children = packing.evolve(triplets(20, 1), 1000, [], 3)
    assert children == packing.CHILDREN  # the bound is not met, so the epoch is not cut short


def test_packing_is_near_the_bound(spark):
    got = queries.queries()["op1_pack"](spark, FOLDER).agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    assert got[0] <= -(-got[1] // 2048) + 2


def test_media_round_trip(spark):
    rows = [x for x in ODD if x[0] not in (3, None)]
    for r in media.add_media(docs(spark, rows), keep_media=True).collect():
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert media.from_wav(bytes(r["media"])) == payload and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:])) and len(r["times"]) == len(r["codes"])


def test_media_covers_every_byte(spark):
    from itertools import product

    tail = [(b"\x7f" * n + b"\0" * n) * (32 // n) for n in (2, 4, 8, 16)]
    texts = [("small cat " * 128)[:n] + t.decode() for n, t in product((256, 384, 640, 1280), tail)]  # the last 64 bytes are no whole hop
    got = {r["doc_id"]: r for r in media.add_media(docs(spark, list(enumerate(texts))), keep_media=True).collect()}
    assert all(len({got[i]["feature"] for i in range(at, at + 4)}) == 4 for at in range(0, 16, 4))
    assert [got[at]["feature"].split(":")[0] for at in range(0, 16, 4)] == ["2", "3", "5", "10"]
    for r in got.values():
        checksum = zlib.crc32(b"".join(x.to_bytes(4, "little", signed=True) for x in [*r["times"], *r["codes"]]))
        assert r["feature"].split(":")[1:] == [str(len(r["codes"])), f"{checksum:08x}"]
    assert {"media", "times", "codes"} <= set(media.code_media(docs(spark, []).selectExpr("struct(doc_id) AS doc", "text")).columns)


def test_toxicity_held_out(spark):
    got = queries.queries()["op4_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.97
    assert sum(r["predicted"] for r in got if r["toxic"]) / sum(r["toxic"] for r in got) > 0.8


def test_toxicity_learns_pairs(spark):
    """One insult is toxic with one group, another with another, the other pairs are clean: no sum of weights tells that."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    filler = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = []
    for i in range(5000):
        insult, group = ("grubs", "louts")[i // 2 % 2], ("north", "south")[i // 4 % 2]
        named = [insult, group] if i % 2 else []
        rows.append((" ".join([*rng.choice(filler, 8), *named, str(i)]), int(named in (["grubs", "north"], ["louts", "south"]))))
    machine = toxicity.train(spark.createDataFrame(rows[:4000], "text string, label int"))
    right = lambda: ((machine.score(pa.array([t for t, _ in rows[4000:]])) >= 0.5) == np.array([y for _, y in rows[4000:]])).mean()
    assert right() > 0.97
    machine.factor[:] = 0
    assert right() < 0.9


def test_samples_are_bounded(spark, monkeypatch):
    rows = spark.range(30_000).selectExpr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'one text many times' ELSE 'text ' || id END AS text", "CAST(id % 2 AS INT) AS label", "'en' AS lang")
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 50)
    got = toxicity.sample(rows).collect()
    assert len(got) == 50 == len({(r["digest"], r["label"]) for r in got})
    assert len(toxicity.sample(rows.where("text IS NULL OR text LIKE 'one%'")).collect()) == 4
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 50)
    assert language_id.drawn(rows.dropna(), 1).count() == 50
    assert language_id.drawn(rows.where("text LIKE 'one%'"), 1).count() == 1


def test_language_held_out(spark):
    got = queries.queries()["op9_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.98


def test_more_languages_than_a_mask_word(spark):
    letters = "abcdefghijklm"
    names = [f"l{a}{b}" for a in letters for b in letters[:6]]  # 78 languages
    rows = [(f"q{n[1]}{n[2]}z x{n[2]}{n[1]}w ", n) for n in names for _ in range(2 if n == "lmf" else 4)]
    model = language_id.build(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(model.languages) == names and model.languages[-1] == "lmf"
    got = language_id.identify(spark.createDataFrame(rows, "text string, lang string"), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)


def test_quality_agrees_with_labels(spark):
    got = queries.queries()["op7_quality"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    mean = defaultdict(list)
    for r in got:
        mean[r["quality"]].append(r["quality_score"])
    assert sum(mean[1]) / len(mean[1]) > sum(mean[0]) / len(mean[0]) + 0.1


def test_quality_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 50)
    rows = spark.range(3000).selectExpr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'one text many times' ELSE 'text ' || id END AS text")
    got = quality.sample(rows.na.fill("", ["text"])).collect()
    assert len(got) == 50 == len({r["digest"] for r in got}) and {r["copies"] for r in got} <= {1, 1000}
    few = quality.sample(rows.where("text IS NULL OR text LIKE 'one%'").na.fill("", ["text"])).collect()
    assert sorted(r["copies"] for r in few) == [1000, 1000]
    sent, real = [], type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda df: sent.append(real(df)) or sent[-1])
    quality.train(rows)
    assert len(sent) == 2 and max(t.num_rows for t in sent) <= 50


def test_odd_rows_keep_their_place(spark):
    odd, labels = docs(spark, ODD), spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, labels).count() == len(ODD)
    assert quality.score_quality(odd).count() == len(ODD)
    model = language_id.build(odd.withColumn("lang", F.lit("en")).select("text", "lang").dropna())
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(odd, model).collect()}
    assert got[1] == got[2] == got[7] == "und" and got[3] == "en"
    items = spark.createDataFrame([(1, "b c d e f g"), (2, None), (3, ""), (None, "a b")], "item_id long, text string")
    assert {(r[0], r[1]) for r in decontaminate.find_contained(odd, items).select("doc_id", "item_id").collect()} == {(3, 1), (4, 1)}
    assert decontaminate.drop_contaminated(odd, items).count() == len(ODD) - 3
    assert jaccard_join.drop_near_duplicates(odd).where("doc_id = 4").count() == 0


def test_one_row_of_each_component_stays(spark):
    a, b, c, d = ([f"{x}{i}" for i in range(60)] for x in "abcd")
    near = lambda w, *at: " ".join("z" if i in at else x for i, x in enumerate(w))
    rows = [(3, near(a)), (5, near(b)), (5, near(a)), (5, near(a, 1)), (None, near(a, 2)), (None, near(c)), (None, near(c)), (None, near(c, 3))]
    rows += [(7, near(d)), (7, near(d)), (7, near(d, 4)), (8, near(d)), (None, None), (9, ""), (9, "")]
    got = [(r["doc_id"], r["text"]) for r in jaccard_join.drop_near_duplicates(docs(spark, rows)).collect()]
    words = [x for x in got if x[1]]
    assert sorted(x[1][0] for x in words) == ["a", "b", "c", "d"] and {x[1][0]: x[0] for x in words} == {"a": 3, "b": 5, "c": None, "d": 7}
    assert set(words) <= set(rows) and len(got) == 7


def test_empty_tables(spark):
    none = docs(spark, [])
    assert packing.pack_documents(none).count() == media.add_media(none).count() == secrets.find_secrets(none).count() == quality.score_quality(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == decontaminate.find_contained(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert language_id.identify(none, language_id.build(none.select("text", "lang").dropna())).count() == 0
    assert toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame([("block", "a.com", "/x", None), ("allow", "a.com", "/x/y", 1), ("allow", "a.com", "/x", 1), (None, "b", "/", 1)], "action string, host string, path string, note int")
    urls = [None, "", "nothing", "HTTP://A.com/x?q", "http://b.A.COM/x/y#f", "http://xa.com/x", "http://a.com", "http://" + "s." * 5000 + "a.com/x"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("a.com/x", "block"), 4: ("a.com/x/y", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: ("a.com/x", "block")}
    assert url_filter.filter_urls(pages, rules).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_urls_by_the_rules_of_the_contract(spark, tmp_path):
    want = {
        "http://com/en/": ("com/en/", "block"), "http://a.example.com/en/6": ("com/en/", "block"), "http://example.com/en/7": ("example.com/en/7", "allow"),
        "http://m.Example.com/en/71": ("example.com/en/7", "allow"), "http://net/de/": ("net/de/", "allow"), "http://a.example.net/de/7": ("net/de/", "allow"),
        "http://other.net/de/8": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://m.example.net/de/81?q": ("example.net/de/8", "block"),
        "http://org/es/": ("org/es/", "block"), "http://a.example.org/es/1#f": ("org/es/", "block"), "http://a.example.org/en/7": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.op10_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_revisits(spark):
    rows = [
        (1, "http://A.com/p/?utm_source=x#f", 5, "response", 200, "d", {"etag": "1", "date": "a", "x": "k"}),
        (2, "https://a.com/p", 100_000, "revisit", 304, None, {"etag": "1", "date": "b", "server": "s"}),
        (3, "https://a.com/p", 5, "revisit", 304, None, None), (4, None, 7, "revisit", 304, None, None), (5, "http://a.com/p", 6, "revisit", 304, "e", None),
    ]
    captures = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, status int, digest string, headers map<string,string>")
    got = {r["record_id"]: (r["response_id"], r["outcome"], r["status"], r["headers"]) for r in warc_revisit.resolve_revisits(captures).collect()}
    assert got == {2: (1, "match", 200, {"etag": "1", "date": "b", "x": "k"}), 3: (None, "none", 304, {}), 5: (1, "mismatch", 304, {})}
