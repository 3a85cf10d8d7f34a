"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("linecensus.llm")
from linecensus.llm import bpe, flac, graph, langid, minhash, mixing, pii, quality, secrets, vectors, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, cuts string"


def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(rng.randrange(900)) for _ in range(30_000))
    rows = [(0, "a b c", "en", "s1"), (1, None, "en", "s1"), (2, "", None, None), (3, long, "en", "s2"), (4, long, "en", "s2"), (None, "a b c", None, "s2"), (5, "x" * 100_000, "fr", None), (6, "a b c", "en", "s1"), (6, "a b c", "en", "s1"), (7, "123 !?", "fr", "s3"), (8, " \n\t ", "fr", "s3")]
    return spark.createDataFrame([(i, t, l, s, len(t or ""), 1, "k", "c") for i, t, l, s in rows], DOCS)


def same_rows(df, out, id_col="doc_id"):
    assert sorted(str(r[id_col]) for r in out) == sorted(str(r[0]) for r in df.select(id_col).collect())


def find_all(parent, a):
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_by_force(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find_all(parent, a), find_all(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find_all(parent, i)) for i in ids}


def test_minhash_against_all_pairs(spark):
    rng = random.Random(8)
    texts, n = {}, 0
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 60, 400, 1500]))]
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(500)}"
            texts[n] = (" ", "\n")[n % 2].join(x.upper() if n % 3 == 0 else x for x in w)
            n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.classes(df).collect()}
    assert got == near_by_force(texts)


def test_minhash_odd_rows(spark, odd):
    out = minhash.classes(odd).collect()
    same_rows(odd, out)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[8]["kept"] and by[4]["component_id"] == 3 and by[6]["component_id"] == 0 and by[None]["component_id"] == 0 and not by[None]["kept"]
    assert minhash.classes(odd.limit(0)).count() == 0
    assert minhash.kept_documents(odd).columns == odd.columns


def test_sketches_estimate_and_keep_links():
    rng = np.random.default_rng(1)
    for n in (5, 40, 150, 300, 1100, 5000, 20_000):
        far, off = 0, []
        for t in (0.85, 0.75):
            for _ in range(150 if n < 2000 else 25):
                base = np.unique(rng.integers(0, 2**64, 3 * n, np.uint64))
                rng.shuffle(base)
                drop = int(n * (1 - t) / (1 + t))
                a, b = np.sort(base[:n]), np.sort(np.concatenate([base[drop:n], base[n : n + drop]]))
                both = len(np.intersect1d(a, b))
                true = both / (len(a) + len(b) - both)
                x, y = minhash.samples(a), minhash.samples(b)
                p, q = (np.frombuffer(minhash.odd_sketch(s), np.uint8) for s in (x, y))
                z = np.array([np.bitwise_count(p ^ q).sum(dtype=np.int64)])
                sizes = [np.array([v]) for v in (len(a), len(b), len(x), len(y))]
                near = bool(minhash.similar(*sizes, z, 0.85)[0])
                assert near or true < 0.85
                far += near and t == 0.75
                off.append(minhash.estimate(*sizes, z)[0] - true)
        assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.02
        assert n < 100 or far == 0


def test_sketch_is_the_parity_of_the_least_hashes():
    h = minhash.shingles(" ".join(map(str, range(9000))))
    least = {}
    for v in h.tolist():
        least[v >> 52] = min(v, least.get(v >> 52, v))
    some = minhash.samples(h)
    assert some.tolist() == sorted(least.values()) and len(some) < len(h)
    bits = [0] * minhash.BITS
    for v in some.tolist():
        bits[(v * 0xD6E8FEB86659FD93 % 2**64) >> 53] ^= 1
    assert np.unpackbits(np.frombuffer(minhash.odd_sketch(some), np.uint8)).tolist() == bits


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {v: v for e in edges for v in e}
    for a, b in edges:
        x, y = find_all(parent, a), find_all(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {**{v: v for v in parent}, **got} == {v: find_all(parent, v) for v in parent}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 24))
    x = np.concatenate([x, x[:30] + 0.08 * rng.normal(size=(30, 24)), x[:10] * 3, x[:5], np.repeat(x[:1], 40, 0) + 0.05 * rng.normal(size=(40, 24))]).astype(np.float32)
    labels = [int(i % 2) for i in range(60)] + [int(i % 2) for i in range(30)] + [int(i % 2) for i in range(10)] + [int(i % 2) for i in range(5)] + [0] * 40
    rows = [(i, v.tolist(), l, "c") for i, (v, l) in enumerate(zip(x, labels))]
    n = len(rows)
    rows += [(n, None, 1, "c"), (n + 1, [0.0] * 24, 1, "c"), (n + 2, [float("nan")] * 24, 1, "c"), (n + 3, [1.0, None], 1, "c"), (n + 4, x[0].tolist(), None, "c"), (n + 5, [], 1, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, class string")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(link, False)
    parent = {i: i for i in range(n + 6)}
    for a, b in zip(*np.nonzero(np.triu(link))):
        p, q = find_all(parent, a), find_all(parent, b)
        parent[max(p, q)] = min(p, q)
    want = {i: (int(link[i].sum()) if i < n else 0, int(find_all(parent, i))) for i in range(n + 6)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()} == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_hadamard_keeps_lengths_and_codes_agree():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert (vectors.codes(x, 3, 2) == vectors.codes(x, 3, 2)).all() and vectors.tables_for(64, 1) >= 3


def test_flac_round_trips_and_damage(spark, odd):
    rng = np.random.default_rng(0)
    wave = np.clip(np.cumsum(rng.integers(-3, 4, 576 * 9)) + 128, 0, 255).astype(np.uint8).tobytes()
    raw = [flac.padded(b) for b in (b"", b"a", b"\x80" * 576, rng.bytes(2000), b"abc " * 5000, wave, "Ünï".encode() * 300)]
    media = flac.encode(raw)
    assert flac.decode(media) == raw and len(media[5]) < len(raw[5])
    no_table = [m[:4] + b"\x80" + m[5:42] + m[flac.Stream(m).first :] for m in media]
    assert flac.decode(no_table) == raw  # read in order
    for at in (flac.Stream(media[4]).first + 5, len(media[4]) - 40, 20):
        bad = bytearray(media[4])
        bad[at] ^= 8
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    out = {r["doc_id"]: r for r in flac.digests(flac.to_media(odd)).collect()}
    pad = b"\xff" * 576
    assert out[1]["payload_sha256"] == out[2]["payload_sha256"] == hashlib.sha256(pad).hexdigest() and out[1]["n_bytes"] == 0
    assert out[5]["payload_bytes"] == 100_224 and out[0]["tail_crc32"] == zlib.crc32(b"\xff" * 32) and out[3]["media_sha256"] == out[4]["media_sha256"]
    assert flac.to_media(odd.limit(0)).count() == 0
    blocks = sorted((r["sample_offset"], bytes(r["pcm"])) for r in flac.pcm_blocks(flac.to_media(odd.filter("doc_id = 5"))).collect())
    assert b"".join(p for _, p in blocks) == flac.padded(b"x" * 100_000) and [o for o, _ in blocks] == list(range(0, 100_224, 64 * 576))


def plain_secrets(text):
    found = []
    for k, (name, p, least) in enumerate((("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6), ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24))):
        found += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in p.finditer(text or "") if len(m[2] if k == 0 else m[0]) >= least]
    return [s for _, _, s in sorted(found)]


def test_secrets(spark, odd):
    rng = random.Random(6)
    parts = ["password", "token", "API_KEY", "secret = ", ": ", "'", '"', "=", "abcdef12", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", " ", "é", "😀", "xyz."]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randrange(30))) for i in range(400)}
    key, shared = "q7Zr9Tk2Lm4Xw8Vb6Nc1Hd3Jf5Gs0Pa", "r8Ys1Ul3Mn5Yx9Wc7Od2Ie4Kg6Ht1Qb"
    rows = [(i, t, "en", f"s{i % 9}") for i, t in texts.items()] + [(1000, f"see {key} end", "en", "s1")] + [(1001 + k, f"see {shared} end", "en", f"s{k}") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in secrets.secret_rows(df).collect()}
    for i, t in texts.items():
        want = plain_secrets(t)
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in out[i]["spans"].split(",") if s and not s.startswith("generic")] == want
        assert [out[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
    assert out[1000]["spans"] == f"generic:4:{4 + len(key)}"
    assert out[1001]["spans"] == "" and out[1001]["n_example"] == 1  # copied by many owners
    red = {r["doc_id"]: r["text"] for r in secrets.redacted_documents(df).collect()}
    assert red[1000] == "see [SECRET] end" and red[1001] == f"see {shared} end"
    same_rows(odd, secrets.secret_rows(odd).collect())
    assert secrets.redacted_documents(odd).columns == odd.columns and secrets.redacted_documents(odd).count() == odd.count()
    assert secrets.secret_rows(odd.limit(0)).count() == 0


def test_quality(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = documents(spark, data), spark.read.parquet(f"{data}/labels.parquet")
    out = {r["doc_id"]: r for r in quality.score(docs, labels).collect()}
    own = [(out[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in out]
    held = [(o, q) for o, q in own if o["held_out"]]
    assert np.mean([o["predicted"] == q for o, q in held]) >= 0.95
    assert all(o["held_out"] == (zlib.crc32(str(o["doc_id"]).encode()) % 3 == 1) and 0 <= o["score"] <= 1 for o in out.values())


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, None), (3, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    same_rows(odd, quality.score(odd, labels).collect())
    assert quality.score(odd.limit(0), labels.limit(0)).count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.array([k % 2, 2 + rng.integers(0, 8)]) for k in range(200)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(200)])
    w = quality.dual_descent(rows, [np.ones(2) for _ in rows], y, 10)
    assert all((w[r].sum() + w[-1]) * t > 0 for r, t in zip(rows, y))


def test_langid(spark, odd):
    docs = documents(spark, "/root/testdata/sf0.01")
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    held = [(out[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs.collect() if out[r["doc_id"]]["held_out"]]
    assert np.mean([p == l for p, l in held]) >= 0.97
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 7, 8)] == ["und"] * 4 and got[0]["lang_pred"] in ("en", "fr")
    kept = langid.known_documents(odd)
    assert kept.columns == odd.columns and {1, 2, 7, 8}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert langid.identify(odd.limit(0)).count() == 0


def test_langid_pieces_do_not_change_counts(monkeypatch):
    model = langid.Model(["a"], np.full((1, 1 << 10), 1, np.uint64), 0)
    text = "the quick brown fox " * 200
    whole = model.predict([text, "x y", text])
    n_whole = sum(len(langid._grams(c)[0]) for _, _, c, _ in langid._pieces([text]))
    monkeypatch.setattr(langid, "PIECE", 997)
    assert model.predict([text, "x y", text])[0] == whole[0]
    n = sum(len(langid._grams(c)[0]) for _, _, c, _ in langid._pieces([text]))
    assert abs(n - n_whole) <= 6 * (len(text) // 997 + 1)


def plain_pii(t):
    p = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
    d = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in p[0].finditer(t)] + [(1, *m.span()) for m in p[1].finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    return out + [(2, *m.span()) for m in p[2].finditer(t) if 16 <= len(d(m)) <= 19 and pii.luhn(d(m))] + [(3, *m.span()) for m in p[3].finditer(t) if 8 <= len(d(m)) <= 15]


def test_pii_base_spans():
    rng = random.Random(0)
    for _ in range(8000):
        t = "".join(rng.choice(["a", "b@", "@", ".", "1", "2", "25", "300", "+", "+1", "-", " ", "(", ")", "é", "4111 1111 1111 1111", ".com", "0"]) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == plain_pii(t)


def test_pii_model_on_held_out_sentences():
    w, hits, wrong, missed = pii.trained(), 0, 0, 0
    for text, spans in pii.generated(200, 77):
        got = {x for a, z in pii.zones(text) for x in pii.decode(text, a, z, w)}
        hits, wrong, missed = hits + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.95


def test_pii_dynamic_program_is_the_best_segmentation():
    w = pii.trained()

    def best(segments, at):
        return max([0.0] + [s + best(segments, j) for i, j, s in segments if i >= at])

    for text, _ in pii.generated(40, 5):
        for a, z in pii.zones(text):
            tokens, found = pii._scored(text, a, z)
            segments = [(i, j, s) for i, j, k, f in found if (s := sum(w.get(x, 0.0) for x in f)) > 0]
            if len(segments) > 14:
                continue
            got = 0.0
            for k, s, e in pii.decode(text, a, z, w):
                got += sum(w.get(x, 0.0) for x in pii._features(k, text, s, e))
            assert got == pytest.approx(best(segments, 0))


def test_pii_rows(spark, odd):
    out = pii.scan(odd).collect()
    same_rows(odd, out)
    assert {r["doc_id"]: r for r in out}[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    df = spark.createDataFrame([(1, "tel (743) 555-3824 or a@b.co"), (2, "+1 (743) 555-3824")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.scan(df).collect()}
    assert got == {1: "email:22:28,phone:4:18", 2: "phone:0:17"}
    assert pii.scan(odd.limit(0)).count() == 0


def test_mixing(spark, data):
    docs = documents(spark, data)
    out = mixing.mix(docs).collect()
    total = sum(r["size"] for r in out)
    taken, target, size = defaultdict(int), {}, {}
    for r in out:
        key = r["source_size"]
        taken[key] += r["taken"]
        target[key], size[key] = r["target"], r["source_size"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum(target.values()) == pytest.approx(1.5 * total) or len(target) < docs.select("source").distinct().count()
    for k in target:
        assert target[k] <= 2 * size[k] + 1e-6 and abs(taken[k] - target[k]) <= max(0.05 * target[k], 60)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}


def test_mixing_targets_by_hand(spark, odd):
    rows = [(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(10, "a"), (10, "b"), (100, "c"), (100, None)])]
    out = {r["source_size"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source_size = 10").collect()}
    assert out == {10: 20.0}
    same_rows(odd, mixing.mix(odd).collect())
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd).columns == odd.columns


def test_bpe_equals_the_library(spark, odd):
    tok = bpe._tokenizer(bpe.default_path())
    rng = random.Random(1)
    units = [*"ab'sSTre 1éé̸ÅΩǅΣİ \x1c\x1d\x85 　\n\t!!中\U0001f600​''ll\x00", "<|endoftext|>", "<|startoftext|>", "'re"]
    rows = [(i, "".join(rng.choice(units) for _ in range(rng.randint(0, 40)))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    out = defaultdict(list)
    for r in bpe.digests(df).collect():
        out[r["doc_id"]].append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    for r in df.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert want in out[r["doc_id"]]
    assert sum(map(len, out.values())) == df.count()
    assert bpe.digests(df.limit(0)).count() == 0
    enc = bpe.encode(df.filter("doc_id < 50"))
    assert {(r["doc_id"], r["decoded"]) for r in enc.collect()} == {(r["doc_id"], r["decoded"]) for r in bpe.decode(enc).collect()}


def test_warc(spark):
    rows = [(1, "http://a", "x" * 1000, "c"), (2, "http://a b\r\n", "x" * 1000, "c"), (3, None, "x" * 999, "c"), (4, "u", "x" * 999, "c"), (5, "u", None, "c"), (None, "u", "x" * 1000, "c"), (2, "http://a b\r\n", "x" * 1000, "c"), (6, "u", "é" * 600, "c"), (7, "v", "é" * 600, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    d = {i: hashlib.sha1((h or "").encode()).hexdigest() for i, _, h, _ in rows}
    want = [("1", 1000, d[1], "revisit", 2), ("2", 1000, d[2], "response", None), ("2", 1000, d[2], "response", None), ("3", 999, d[3], "response", None), ("4", 999, d[4], "response", None), ("5", 0, d[5], "response", None), ("6", 1200, d[6], "revisit", 7), ("7", 1200, d[7], "response", None), ("None", 1000, d[None], "revisit", 2)]
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reads_selected_records(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    index = warc.write(pages, f"file://{tmp_path}/w")
    some = warc.read(index.filter("page_id % 7 = 0"), f"file://{tmp_path}/w").collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(some) == sum(i % 7 == 0 for i in html) and all(bytes(r["payload"]).decode() == html[r["page_id"]] for r in some)
    head, _, _ = warc.parse(warc.record(1, "http://x", b"abc"))
    assert head["warc-type"] == "response"


def test_pipeline(spark, data):
    import corpus_pipeline as p

    docs = documents(spark, data)
    out = p.run(spark, data).collect()
    ids = {r["doc_id"] for r in out}
    kept = {r["doc_id"] for r in minhash.classes(docs).filter("kept").collect()}
    assert ids and ids <= kept and [n for n, _ in p.STAGES] == ["language", "near_dup", "secrets", "mix", "tokens"]
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs, data).columns == docs.columns


def test_near_dup_stage_takes_pairs_from_080(spark):
    import corpus_pipeline as p

    rng = random.Random(12)
    rows, want = [], set()
    for i in range(60):
        w = [f"w{i}x{rng.randrange(10**6)}" for _ in range(100)]
        near, far = list(w), list(w)
        for k in (20, 60):
            near[k] = "new"  # 86 of 106 shingles: 0.811
        for k in (10, 20, 60):
            far[k] = "other"  # 81 of 111: 0.730
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
        want |= {3 * i, 3 * i + 2}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in p.near_dup(spark, df, "").collect()} == want
    for t in (0.7, 0.8, 0.85, 0.9):
        n, k = minhash.banding(t)
        assert (1 - t**k) ** n < 1e-6
    assert minhash.banding(0.85) == (25, 5)


def test_kept_documents_leaves_one_row_of_each_group(spark):
    w = [f"w{k}" for k in range(100)]
    near, other = " ".join([*w[:50], "new", *w[51:]]), " ".join(f"o{k}" for k in range(100))
    rows = [(5, " ".join(w)), (5, " ".join(w)), (7, near), (None, other), (None, other), (None, near), (9, "alone"), (9, "alone"), (9, "another text"), (10, None)]
    out = minhash.kept_documents(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.8).collect()
    assert sorted(out, key=str) == sorted([(5, " ".join(w)), (None, other), (9, "alone"), (9, "another text"), (10, None)], key=str)
