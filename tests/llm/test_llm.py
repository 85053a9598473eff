"""Operators against brute force and their defined results on odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import (
    components, exact_dedup, fingerprints, language_id, license_scan, minhash_dedup, mixing, packing, registry, substring_dedup, toxicity, url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, rank int"
ODD = [None, "", "  ", "x", "a b", "same text here", "same text here", "123 !!", "\n\n", "é ü ß", "longer " * 3000]


def odd_docs(spark, rows=None):
    rows = ODD if rows is None else rows
    return spark.createDataFrame([(i, t, None, None if i % 3 else f"s{i % 2}", len(t or ""), "k", "c", 1) for i, t in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=70)
    texts = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randrange(1, 160))
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = shared
        texts.append(" ".join(w))
        if i % 6 == 0:
            texts.append(texts[-1])
        if i % 7 == 0 and len(w) > 60:
            w[3] = "edited"
            texts.append(" ".join(w))
    return spark.createDataFrame([(3 * i, t, None, f"s{i % 4}", len(t), "k", "c", 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def test_fuse_filter_holds_its_keys():
    for n in (0, 1, 3, 1000):
        keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        made = exact_dedup.build_filter(keys)
        assert exact_dedup.may_hold(keys, **made).all()
    assert exact_dedup.may_hold(np.arange(50_000, dtype=np.uint64), **made).mean() < 0.001


def test_substring_dedup_brute_force(docs):
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, with_text=True).collect()}
    starts, rows = {}, sorted((r["doc_id"], r["text"].split()) for r in docs.collect())
    for d, w in rows:
        for i in range(len(w) - 49):
            starts.setdefault(tuple(w[i : i + 50]), d)
    for d, w in rows:
        gone = {j for i in range(len(w) - 49) if starts[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[d]["n_removed"], got[d]["kept_text"]) == (len(gone), kept)


def test_near_components_brute_force(docs):
    rows = {r["doc_id"]: r["text"].lower().split() for r in docs.collect()}
    sets = {d: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)} for d, w in rows.items()}
    label = {d: d for d in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[x] == label[label[x]] for x in label):
            break
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_components(docs).collect()} == label


def star_texts(copies, seed=5):
    """A base, and copies too far from it that come in pairs near to one another only."""
    rng = random.Random(seed)
    base, texts = [f"b{i}" for i in range(200)], []
    texts.append(base)
    for i in range(copies):
        w = list(base)
        for at in rng.sample(range(200), 14):
            w[at] = f"x{i}-{at}"
        near = list(w)
        near[rng.randrange(200)] = "y"
        texts += [w, near]
    return [" ".join(w) for w in texts]


def test_leaves_that_link_only_with_one_another(spark, monkeypatch):
    pairs, made = {}, []
    search = minhash_dedup._rest_pairs

    def counted(*given):
        found = search(*given)
        made.append(found.count())
        return found

    monkeypatch.setattr(minhash_dedup, "_rest_pairs", counted)
    for copies in (20, 200):
        texts = star_texts(copies)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in map(str.split, texts)]
        apart = [100 * len(sets[0] & s) < 85 * len(sets[0] | s) for s in sets[1:]]
        got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_components(docs).collect()}
        assert all(apart) and got == {0: 0} | {i: i - (i % 2 == 0) for i in range(1, len(texts))}
        pairs[copies] = made.pop()
    assert pairs[200] <= 12 * pairs[20]


def test_near_stage_brute_force(spark, docs):
    import corpus_pipeline

    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = [r["text"] for r in docs.collect()]
    for n in (60, 120, 500, 500, 500):
        w = rng.choices(vocabulary, k=n)
        block = w[: n // 2] + rng.choices(vocabulary, k=n // 5) + w[n // 2 :]  # five words 0.82, three words 0.827
        edits = [rng.choice(vocabulary) if i % 40 == 20 else x for i, x in enumerate(w)]  # three words 0.86, five words 0.78
        texts += [" ".join(x) for x in (w, block, edits, w[n // 6 :])]
    rows = {3 * i: t.lower().split() for i, t in enumerate(texts)}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, w in rows.items()}
    label, last = {d: d for d in rows}, None
    links = [(a, b) for a in rows for b in rows if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while label != last:
        last = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    given = spark.createDataFrame([(3 * i, t, None, "s", len(t), "k", "c", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, given, "").collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {d: texts[d // 3] for d in rows if label[d] == d}


SPECIAL = ["hello <|endoftext|> world", "<|endoftext|>", "one two<|endoftext|><|endoftext|>\nthree", "<|endoftext> plain"]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = odd_docs(spark, [*ODD, " x\n\n y", "a  b", "the end.\nThe start", *SPECIAL])
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {r["doc_id"]: np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in docs.collect()}
    assert len(ids[len(ODD) + 3]) == 5  # "hello", " ", the added token, " world", the end
    pieces = packing.pack(docs).toPandas()
    for doc, mine in pieces.sort_values("start").groupby("doc_id"):
        assert mine["length"].sum() == len(ids[doc]) and list(mine["start"]) == list(mine["length"].cumsum() - mine["length"])
        for p in mine.itertuples():
            assert zlib.crc32(ids[doc][p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[doc])
    for _, mine in pieces.sort_values("offset").groupby("sequence_id"):
        assert mine["length"].sum() <= 2048 and list(mine["offset"]) == list(mine["length"].cumsum() - mine["length"])
    assert set(pieces["doc_id"]) == set(ids)


def padding(pieces):
    used = pieces.groupby("sequence_id")["length"].sum()
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in used) / used.sum()


def test_packing_pads_little_and_ignores_partitions(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(("stone", "river", "the", "of", "blue"), k=rng.choice((3, 40, 300, 2500))))) for i in range(700)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")  # five rows repeat
    one, two = (packing.pack(docs.repartition(n)).toPandas() for n in (2, 7))
    order = list(one.columns)
    assert one.sort_values(order).values.tolist() == two.sort_values(order).values.tolist()
    assert padding(one) < 0.01 and (one[one["start"] == 0].groupby("doc_id").size() == [2] * 5 + [1] * 695).all()
    assert packing.pack(docs.limit(0)).count() == 0


def test_patterns_fill_sequences():
    demand = np.bincount(np.random.default_rng(2).integers(0, 64, 5000), minlength=64)
    rows, n = packing.rounded_places(demand, 64)
    dealt = sum((last - first) * size for size, first, last, _, _ in rows)
    assert dealt <= n * 64 and dealt > 0.98 * n * 64


def test_mixing_targets(docs):
    rows = mixing.mix(docs).toPandas()
    assert (rows["taken"] <= 3 * rows["size"]).all()
    taken = docs.select("doc_id", "source").toPandas().merge(rows, on="doc_id").groupby("source").agg({"taken": "sum", "target": "first"})
    assert (abs(taken["taken"] - taken["target"]) <= 1).all() and abs(taken["target"].sum() - rows["size"].sum()) < 1e-6
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(len(r["text"].split()) for r in mixed.collect()) == rows["taken"].sum()


def test_mixing_of_repeated_rows(spark):
    rows = [(i, f"one two three four five {i}", None, "a", 24) for i in range(30)] + [(7, "w x y z v", None, "a", 9)] * 6 + [(8, "p q", None, None, 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mixed_documents(docs).collect()
    assert sum(len(r["text"].split()) for r in mixed) == mixing.mix(docs).agg({"taken": "sum"}).first()[0]
    assert len([r for r in mixed if r["text"].startswith("w")]) <= 18


def test_fingerprints_brute_force(docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    sets = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} or {tuple(t.split())}
    like = lambda x, y: len(sets(x) & sets(y)) / len(sets(x) | sets(y))
    off = []
    for i, (d, t) in enumerate(rows):
        m, after = len(t) // 3, rows[(i + 1) % len(rows)][1]
        edited = t[: len(t) - m] + after[:m]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off += [got[d]["near_edited"] - like(t, edited), got[d]["near_next"] - like(t, after)]
        if max(len(sets(t)), len(sets(edited))) <= fingerprints.LEAST:
            assert abs(off[-2]) < 1e-9
    assert max(map(abs, off)) < 0.35 and np.mean(np.abs(off)) < 0.06 and abs(np.mean(off)) < 0.03
    prints = {}
    for d, t in rows:
        prints.setdefault(t, set()).add(got[d]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_sketches_merge_and_contain(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    large = rng.choices(words, k=4000)
    pairs = [(" ".join(large[100:1300]), " ".join(large)), (" ".join(large[:3]), " ".join(large)), ("", " ".join(large)), (" ".join(rng.choices(words, k=900)), " ".join(large)), ("a b c d e f g", "a b c d e f g h")]
    df = spark.createDataFrame([(i, a, b, f"{a} {b}") for i, (a, b) in enumerate(pairs)], "i int, a string, b string, ab string")
    df = fingerprints.sketch_text(df, "a", "sa", "i", "b", "ab")
    df = fingerprints.sketch_text(df, "b", "sb", "i", "sa", "ab")
    df = fingerprints.sketch_text(df, "ab", "sab", "i", "sa", "sb")
    df = fingerprints.with_likeness(fingerprints.merged(fingerprints.containment(df, "sa", "sb", "c"), "sa", "sb", "m"), "m", "sab", "like")
    got = {r["i"]: r for r in df.collect()}
    assert got[0]["c"] == 1.0 and got[2]["c"] == 1.0 and got[3]["c"] == 0.0 and got[4]["c"] == 1.0
    assert got[1]["c"] in (None, 0.0)  # its one shingle of three words is none of the other's
    assert all(got[i]["like"] > 0.85 for i in (0, 3)) and len(got[0]["m"]["hashes"]) < 800


LEAST_ID = -(2**63)
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, sha string, n long, key long, lang_pred string, lang_score double, component string, size int, taken long, part int, number long, node string, kept boolean, copy int"


@pytest.mark.parametrize("name", ["language_id", "exact_dedup", "minhash_dedup", "mixing", "packing"])
def test_pipeline_stages_on_odd_tables(spark, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    extra = ("r", 1, "s", 2, 3, "l", 0.5, "c", 4, 5, 6, 7, "n", True, 8)
    rows = [(LEAST_ID if i == 4 else None if i == 3 else i, t, None, None if i % 3 else "s", len(t or ""), *extra) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows + rows[4:6] + [(None,) * 20], CLASHING)
    got = stage(spark, docs, "")
    found = got.collect()
    assert stage(spark, docs.limit(0), "").count() == 0
    if name == "packing":
        assert sum(r["length"] for r in found if r["doc_id"] == LEAST_ID) == 2 * next(r["doc_tokens"] for r in found if r["doc_id"] == LEAST_ID)
        return
    assert got.columns == docs.columns and all(tuple(r)[5:] == extra for r in found if r["row"])
    texts = [r["text"] for r in found]
    if name == "language_id":
        assert sorted(texts) == sorted(t for t in [*ODD, *ODD[4:6]] if t and any(c.isalpha() for c in t))
    if name == "exact_dedup":
        assert sorted(t or "" for t in texts) == sorted({t or "" for t in ODD})
    if name == "minhash_dedup":
        assert texts.count("same text here") == 2 and texts.count("a b") == 2 and len([t for t in texts if not t]) == 3
    if name == "mixing":
        words = sum(len(r["text"].split()) for r in found)
        assert words == mixing.mix(docs).agg({"taken": "sum"}).first()[0]


def test_fingerprints_of_the_least_id(spark):
    docs = spark.createDataFrame([(LEAST_ID, "a b c"), (5, "d e f g"), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(docs).collect()}
    assert got[5] == hashlib.sha256(b"d e fa ").hexdigest() and len(got) == 3


def test_language_and_toxicity_on_held_out_rows(spark, sf_dir):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in language_id.op8_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    scores = toxicity.op6_toxicity(spark, sf_dir).collect()
    assert len(scores) == len(docs) and all(0 <= r["score"] <= 1 for r in scores)


def test_toxicity_held_out_precision_and_recall(spark):
    rng = random.Random(3)
    words, bad = [f"t{i}" for i in range(3000)], [*toxicity.LEXICON[:6], "zzyx", "qwok"]
    rows = []
    for i in range(900):
        w = rng.choices(words, k=rng.randrange(5, 300))
        toxic = int(i % 12 == 0)
        for b in rng.sample(bad, 3) if toxic else []:
            w.insert(rng.randrange(len(w)), b)
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs.select("doc_id", "toxic"))
    y = {i: t for i, _, t in rows}
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    hits = sum(got[i] and y[i] for i in got)
    assert hits >= 0.9 * sum(y[i] for i in got) and hits >= 0.9 * sum(got.values())
    for labels in (docs.limit(0), docs.where("toxic = 0"), docs.select("doc_id", F.lit(None).cast("int").alias("toxic"))):
        assert toxicity.train(docs, labels.select("doc_id", "toxic"))[""] < 0


def test_letters_of_all_scripts_have_vectors_of_their_own():
    space = language_id.Space()
    one, two, again = (space.bundle(t) for t in ("\u043f\u0440\u0438\u0432\u0435\u0442", "\u03b3\u03b5\u03b9\u03b1\u03c3\u03bf\u03c5", "\u043f\u0440\u0438\u0432\u0435\u0442"))
    assert (one == again).all() and abs(float(one @ two)) < 0.3 * float(one @ one)
    other = language_id.Space()
    other.bundle("zyx \u4e00\u4e8c\u4e09 " + "".join(map(chr, range(0x4E00, 0x4F00))))
    assert (other.bundle("\u043f\u0440\u0438\u0432\u0435\u0442") == one).all()


def test_url_filter_aliases(spark):
    pages = spark.createDataFrame([
        (1, "http://a.example.com/en/x", '<link rel="canonical" href="/en/y">'), (2, "http://q.org/z", "<LINK href='http://a.example.com/en/y' rel=canonical>"),
        (3, None, None), (4, "zz", ""), (5, "http://www.example.com/en/1", '<meta http-equiv="refresh" content="0; url=http://q.org/z#k">'), (6, "http://Free.org?x", None),
    ], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2] == ("q.org", "/z", None, "block")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5][2:] == ("www.example.com/en/", "allow") and got[6] == ("free.org", "", None, "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_filter_reads_tags_as_a_page_does(spark):
    to = "http://example.com/en/1"
    html = {
        f'<!-- <link rel=canonical href="{to}"> -->': "allow", f'<link data-rel="canonical" href="{to}">': "allow", f'<link rel=canonical data-href="q" href="{to}">': "block",
        f"<link rel='x canonical' href='/zz'><link rel=canonical href='{to}'>": "block", f'<script>"<link rel=canonical href={to}>"</script>': "allow",
        '<meta content="5;URL=http://example.com/en/9" HTTP-EQUIV="Refresh">': "block", f'<link title="a > b" rel="canonical" href="{to}"/>': "block",
        f'<link title="rel=canonical href={to}">': "allow", "<link rel=canonical>": "allow", "<link": "allow",
    }
    pages = spark.createDataFrame([(i, f"http://q{i}.org/", h) for i, h in enumerate(html)] * 2, "page_id long, url string, html string")
    assert sorted((r["page_id"], r["verdict"]) for r in url_filter.judge(pages).collect()) == sorted(list(enumerate(html.values())) * 2)
    moved = spark.createDataFrame([("http://r.org/a#x", "HTTP://EXAMPLE.com/en/7"), ("http://r.org/a", "http://r.org/b"), (None, "x")], "from_url string, to_url string")
    some = spark.createDataFrame([(1, "http://R.org/b", None), (2, "http://r.org/c", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(some, redirects=moved).collect()} == {1: "block", 2: "allow"}


def test_license_scan(spark):
    texts = ["Intro\nReleased under the MIT License.\nend", "Licensed under the Apache License, Version 2.0.", "He has a license to drive", None, "Licensed under CC BY-NC 4.0."]
    got = {r["doc_id"]: r["licence"] for r in license_scan.scan(odd_docs(spark, texts)).collect()}
    assert got == {0: "mit", 1: "apache-2.0", 2: None, 3: None, 4: "cc-by-nc"}


def test_license_scan_of_wrapped_notices(spark):
    texts = [
        "x\nLicensed under the Creative Commons Attribution-\nNonCommercial 4.0 International License\ny", "GNU Lesser General Public\nLicense", "This code is licensed under GPLv3.",
        "Released under the MIT License\nReleased under the GPL version 2", "Released under the GPL version 2\nReleased under the LGPL", "the plain\nold text", "Released under\nLGPLv2.1",
    ]
    got = {r["doc_id"]: (r["licence"], r["families"], r["n_paragraphs"]) for r in license_scan.scan(odd_docs(spark, texts)).collect()}
    assert got[0] == ("cc-by-nc", ["cc-by-nc"], 1) and got[1] == ("lgpl", ["lgpl"], 1) and got[2][0] == "gpl"
    assert got[3][1:] == (["gpl", "mit"], 2) and got[4][1:] == (["gpl", "lgpl"], 2) and got[5] == (None, [], 0) and got[6][0] == "lgpl"


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_input(spark, rows):
    docs = odd_docs(spark, rows)
    docs = docs.unionByName(docs.limit(2)) if rows else docs
    n = docs.count()
    assert exact_dedup.exact_dedup(docs).count() == n
    assert minhash_dedup.near_components(docs).count() == n
    assert substring_dedup.remove_repeats(docs).count() == n
    assert license_scan.scan(docs).count() == n
    assert mixing.mix(docs).count() == n
    assert fingerprints.fingerprints(docs).count() == len(rows)
    judged, lang, _ = language_id.identify(docs, language_id.train(docs))
    assert judged.count() == n and judged.where(f"text IS NULL AND {lang} <> 'und'").isEmpty()
    assert toxicity.score(docs, {"": -3.0}).count() == n
    assert exact_dedup.keep_one(docs).count() == len({t or "" for t in rows})
    assert minhash_dedup.keep_one(docs).columns == docs.columns


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), "a", "b").count() == 0


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_components_brute_force(spark):
    rng = random.Random(11)
    path = [(i, i + 1) for i in range(1000, 1060)]
    mixed = [(i * 37 % 61 + 2000, (i + 1) * 37 % 61 + 2000) for i in range(60)]
    hub = [(3000 + rng.randrange(5), 3100 + i) for i in range(300)]
    for edges in (path + mixed + hub, [(rng.randrange(400), rng.randrange(400)) for _ in range(260)], [(5, 4), (4, 5), (5, 3)]):
        least = {x: x for e in edges for x in e}
        for _ in least:
            before = dict(least)
            for a, b in edges:
                least[a] = least[b] = min(least[a], least[b])
            if least == before:
                break
        linked = {x for a, b in edges if a != b for x in (a, b)}
        rows = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
        assert len(rows) == len(linked) and dict(rows) == {x: least[x] for x in linked}


def _page(i, url, target="", base=None, tag="link"):
    head = f'<base target="x"><base href="{base}">' if base is not None else ""
    link = f'<link rel="canonical" href="{target}">' if tag == "link" else f'<meta http-equiv="refresh" content="0; url={target}">'
    return (i, url, head + (link if target else ""))


def test_url_filter_resolves_targets_as_a_reader_does(spark):
    from urllib.parse import urldefrag, urljoin

    rng = random.Random(12)
    parts = ["a", "b", "..", ".", "c.html", "%2e"]
    rows = []
    for i in range(300):
        path = "/".join(rng.choices(["a", "b", "c"], k=rng.randrange(4)))
        url = f"http://h{i % 5}.org/{path}" + rng.choice(["", "/" if path else "", "?q=1", "#f", "?x=/y/../z"])
        target = rng.choice(["", "", "/", "//H9.org/", "http://o.org/"]) + "/".join(rng.choices(parts, k=rng.randrange(1, 5))) + rng.choice(["", "?k=v", "#z", "?k=../v"])
        base = rng.choice([None, None, "/x/y/", "../up/", "https://other.org/d/e"])
        rows.append((i, url, target, base))
    got = url_filter.alias_edges(spark.createDataFrame([_page(i, u, t, b, rng.choice(["link", "meta"])) for i, u, t, b in rows], "page_id long, url string, html string"))

    def key(url):
        head, _, rest = urldefrag(url).url.partition("://")
        host, slash, path = rest.partition("/")
        host, q, query = (host, "", "") if slash else host.partition("?")
        path, q2, query2 = path.partition("?") if slash else ("", q, query)
        kept = []
        for k, p in enumerate(segments := path.split("/")):
            if p == "..":
                kept = kept[:-1]
            if p in (".", "..") and k == len(segments) - 1:
                kept.append("")
            elif p not in (".", ".."):
                kept.append(p)
        return f"{head.lower()}://{host.lower()}/" + "/".join(kept) + q2 + query2

    want = set()
    for _, url, target, base in rows:
        seen = urljoin(url, base) if base is not None else url
        a, b = key(url), key(urljoin(seen, target))
        if a != b:
            want.add((a, b))
    found = {(r["a"], r["b"]) for r in got.collect()}
    assert found == want


def test_url_filter_blocks_what_resolves_to_a_blocked_url(spark):
    rows = [
        _page(1, "http://q.org/k", "http://example.com/en/x"), _page(2, "http://q.org/d/e", "../k"),
        _page(3, "http://r.org/p?x=1", "?a=1"), _page(4, "http://r.org/p?a=1", "http://x.net/es/1", tag="meta"),
        _page(5, "http://s.org/1", "2", base="http://t.org/d/"), _page(6, "http://t.org/d/2", "http://x.net/fr/&#x41;&amp;b"),
        _page(7, "http://u.org/1", "mailto:a@example.com"), _page(8, "http://v.org", "http://example.com/e/../en/"), (None, "http://v.org/#top", None),
    ]
    got = [(r["page_id"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got, key=str) == sorted([(i, "block" if i != 7 else "allow") for i in range(1, 9)] + [(None, "block")], key=str)


def test_url_rules_that_tie(spark):
    rules = (("b.org", "/x", "block"), ("b.org", "/x", "allow"), ("org", "/xaa", "block"))
    got = url_filter.judge(spark.createDataFrame([(1, "http://b.org/xaay", None)], "page_id long, url string, html string"), rules).first()
    assert (got["rule"], got["verdict"]) == ("b.org/x", "allow")


def test_language_stage_keeps_by_language_and_score(spark):
    rows = [(i, t, g, None, 0, "k", "c", 1) for i, (t, g) in enumerate([("the cat sat on the mat and the dog", "en"), ("der hund und die katze sind nicht da", "de")] * 20 + [("the dog and the cat", None), ("die katze und der hund", None), ("123", None), (None, None)])]
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = lambda df: sorted(r["doc_id"] for r in df.where("doc_id >= 40").collect())
    assert ids(language_id.with_known_language(docs)) == [40, 41]
    assert ids(language_id.with_known_language(docs, {"de"})) == [41]
    assert ids(language_id.with_known_language(docs, least=0.999)) == []
    with pytest.raises(ValueError, match="labelled"):
        language_id.with_known_language(docs.where("lang IS NULL"), {"de"})
