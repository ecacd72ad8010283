"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, minhash_dedup, piece_sampling, quality_classifier, quality_rules, source_mix, token_counts, toxicity, url_filters, warc
from driftline.llm.common import bit_table, only_rows, row_bit_table, split_by_bits, staged, whole_files, with_row_keys

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("every", [True, False])
def test_exact_groups(edge, edge_rows, every):
    groups = defaultdict(list)
    for d, t, *_ in edge_rows:
        groups[normal(t)].append(d)
    found = exact_dedup.exact_groups(edge, every_digest=every).collect()
    assert len(found) == len(edge_rows)
    expect = []
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        expect += [(d, least, len(ids)) for d in ids]
    assert sorted(map(key, expect)) == sorted(key((r["doc_id"], r["keep_id"], r["group_size"])) for r in found)
    assert sum(r["kept"] for r in found) == len(groups)
    if every:
        assert {r["text_sha256"] for r in found} == {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def test_drop_copies_keeps_columns(edge, edge_rows):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(normal(r["text"]) for r in kept.collect()) == sorted({normal(r[1]) for r in edge_rows})


def shingle_set(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def plain_classes(rows, k, percent=80, count=False):
    sets = [shingle_set(t, k) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    if count:
        return len(members)
    return sorted(key((r[0], len(sets[i]), min((x for x in members[find(i)] if x is not None), default=None))) for i, r in enumerate(rows))


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(edge, edge_rows, k):
    found = minhash_dedup.near_duplicates(edge, k).collect()
    assert sorted(key((r["doc_id"], r["n_shingles"], r["component_id"])) for r in found) == plain_classes(edge_rows, k)
    assert sum(r["kept"] for r in found) == plain_classes(edge_rows, k, count=True)


def test_near_duplicates_of_a_large_group(spark, tmp_path):
    """A group of near copies beyond a node's size: branching, blocks and pivots find the same classes."""
    import random

    rng = random.Random(1)
    base = [f"w{rng.randint(0, 999)}" for _ in range(80)]
    rows = []
    for i in range(150):
        own = list(base)
        own[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(f"v{rng.randint(0, 9999)}" for _ in range(50))) for i in range(150, 180)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = with_row_keys(spark.read.parquet(str(tmp_path / "d")), "tag")
    found = minhash_dedup.classes(docs, 5, node=24).collect()
    group = Counter(r["root"] for r in found)
    expect = Counter(k[2][1] for k in plain_classes(rows, 5))
    assert sorted(group.values()) == sorted(expect.values())


def test_keep_one(edge, edge_rows):
    kept = minhash_dedup.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == plain_classes(edge_rows, 5, count=True)


def test_mix(edge, edge_rows):
    found = source_mix.mix_sources(edge).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(key((r["doc_id"], r["size"])) for r in found) == sorted(key((d, size(t))) for d, t, *_ in edge_rows)
    total = sum(r["size"] for r in found)
    by = {r["source"]: r["target"] for r in found}
    assert sum(by.values()) == pytest.approx(total) and list(sorted(by, key=lambda s: (s is None, s))) == ["a", "b", "c", None]
    for s, target in by.items():
        own = [r for r in found if r["source"] == s]
        assert target <= 3 * own[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    taken = source_mix.take_mix(edge)
    assert taken.columns == edge.columns and taken.count() == sum(r["copies"] for r in found)


def test_no_document_is_taken_a_fourth_time(spark):
    """A source at its cap has nothing left over, not even for documents without words."""
    rows = [(i, "" if i % 2 else "a b c", "small") for i in range(60)] + [(100 + i, "w " * 50, "large") for i in range(60)]
    found = source_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), (1, 100)).collect()
    assert {r["source"]: r["copies"] for r in found if r["size"] and r["source"] == "small"} == {"small": 3}
    assert max(r["copies"] for r in found) == 3


def test_a_larger_budget_takes_a_superset(edge):
    less = {r["doc_id"]: r["copies"] for r in source_mix.mix_sources(edge, share=0.4).where("doc_id <> 12 and doc_id <> 13").collect()}
    more = {r["doc_id"]: r["copies"] for r in source_mix.mix_sources(edge, share=0.7).where("doc_id <> 12 and doc_id <> 13").collect()}
    assert all(more[d] >= c for d, c in less.items())


def test_statistics_of_texts():
    s = dict(zip(quality_rules.COUNTS + quality_rules.MORE, quality_rules.statistics("a b c d e x a b c d e\n\nA|b #\nA|b #".encode())))
    assert s["n_words"] == 15 and s["n_symbols"] == 4 and s["n_dup_lines"] == 1 and s["n_repeat_words"] == 10
    assert quality_rules.statistics(b"")[:5] == (0, 0, 0, 0, 0)
    assert quality_rules.repeated_words(b"a a a a a a".split()) == 6


def test_quality_rules(edge, edge_rows, labels):
    found = quality_rules.judge(edge, labels).collect()
    assert len(found) == len(edge_rows)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["anomaly"] <= 1


def test_limit_is_of_all_labelled_rows(spark):
    """More labelled rows than any sample had, put in order."""
    import numpy as np

    rng = np.random.default_rng(2)
    bad = rng.integers(0, 2, 25_000)
    score = np.round(np.clip(rng.normal(0.4 + 0.2 * bad, 0.1), 0, 1), 3)
    for max_loss in (0.0, 0.01, 0.3):
        best = max(((bad[score >= x].sum() / bad.sum() - (1 - bad[score >= x]).sum() / (1 - bad).sum(), x) for x in np.unique(score) if (1 - bad[score >= x]).sum() / (1 - bad).sum() <= max_loss), default=(0, 2.0))
        limit = quality_rules.best_limit(spark.createDataFrame(list(zip(score.tolist(), bad.tolist())), "anomaly double, bad int"), max_loss)
        assert limit == (best[1] if best[0] > 0 else 2.0)


def test_forest_tells_outliers():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(500, 3)), [[8, 8, 8]]])
    score = quality_rules.Forest.grow(x).score(x)
    assert score.argmax() == 500


def test_token_counts_and_cache(edge, edge_rows, tmp_path):
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path()
    model = Tokenizer.from_file(path)
    cache = str(tmp_path / "cache")
    for _ in range(2):
        found = token_counts.count_tokens(edge, cache, path).collect()
        expect = [(d, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in edge_rows]
        assert sorted(map(key, expect)) == sorted(key((r["doc_id"], r["n_bytes"], r["n_tokens"])) for r in found)
        # copies are encoded once, and nothing on the second run
        assert edge.sparkSession.read.parquet(cache).count() == len({t or "" for _, t, *_ in edge_rows})


def test_a_cache_that_lacks_some_rows(spark, edge, edge_rows, tmp_path):
    """Counts that are stored are taken from the cache, and only the texts that it lacks are encoded."""
    path, cache = token_counts.tokenizer_path(), str(tmp_path / "cache")
    token_counts.count_tokens(edge.where("doc_id < 20"), cache, path).count()
    stored = spark.read.parquet(cache)
    before = stored.count()
    marked = stored.withColumn("n_tokens", F.col("n_tokens") + 1_000_000)  # what can only come from the cache
    marked.write.parquet(str(tmp_path / "marked"))
    known = {r["digest"] for r in stored.collect()}
    found = token_counts.count_tokens(edge, str(tmp_path / "marked"), path).collect()
    text = {d: t for d, t, *_ in edge_rows if d is not None and d != 12}
    for r in found:
        if r["doc_id"] in text:
            digest = hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()
            assert (r["n_tokens"] >= 1_000_000) == (digest in known)
    all_ = len({t or "" for _, t, *_ in edge_rows})
    assert before < all_ and spark.read.parquet(str(tmp_path / "marked")).count() == all_


def test_special_strings_are_the_librarys_default(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    assert token_counts.count_tokens(docs, str(tmp_path / "c"), token_counts.tokenizer_path()).first()["n_tokens"] == 3


URLS = [
    (1, "http://a.example.net/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "https://Example.NET/de/", "example.net", "/de/", "net/", "block"), (3, None, "", "", None, None),
    (4, "no scheme", "", "", None, None), (5, "http://x.example.com/de/?q", "x.example.com", "/de/", "example.com/de/", "block"), (6, "http://b.org/fr/a#t", "b.org", "/fr/a", "org/fr/", "allow"),
    (7, "http://b.org/de/a", "b.org", "/de/a", None, None), (8, "http://net", "net", "", None, None), (9, "http://planet/", "planet", "/", None, None), (10, "ftp://h?x://y/z", "h", "", None, None), (10, "", "", "", None, None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(p, u, "x", "y") for p, u, *_ in URLS], "page_id long, url string, grams_ string, label_ string")
    found = url_filters.judge(pages, url_filters.UrlModel(None)).collect()
    assert sorted(key(tuple(r)[:4]) for r in found) == sorted(key((p, h, path, rule)) for p, _, h, path, rule, _ in URLS)
    assert all(r["verdict"] == dict((u[0], u[5]) for u in URLS if u[4])[r["page_id"]] for r in found if r["rule"])


def test_url_model_learns(spark):
    rows = [(f"spam{i}.biz", "/buy/now", 1) for i in range(40)] + [(f"lib{i}.edu", "/papers/x", 0) for i in range(40)]
    model = url_filters.train(spark.createDataFrame(rows, "host string, path string, blocked int"))
    new = spark.createDataFrame([(1, "http://spam99.biz/buy/now"), (2, "http://lib77.edu/papers/y")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(new, model).collect()} == {1: "block", 2: "allow"}
    one_kind = url_filters.train(spark.createDataFrame(rows[:40], "host string, path string, blocked int"))
    assert one_kind.fitted is None


def test_url_model_on_held_out_names(spark):
    """Names that the model has not seen: no URL of theirs is learned from."""
    rows = url_filters.labelled_urls(spark).toPandas()
    held = {n for words in (url_filters.JUNK_WORDS, url_filters.PLAIN_WORDS) for n in url_filters.names_of(words)[::4]}
    labelled = spark.createDataFrame(rows[~rows["name"].isin(held)])
    new = rows[rows["name"].isin(held)].reset_index(drop=True)
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(zip(new["host"], new["path"]))], "page_id long, url string")
    found = {r["page_id"]: r["verdict"] == "block" for r in url_filters.judge(pages, url_filters.train(labelled), rules=()).collect()}
    right = [found[i] == bool(b) for i, b in enumerate(new["blocked"])]
    assert len(held) > 30 and sum(right) / len(right) > 0.85


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 800 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(1, "http://a/x?y#z", big), (2, "http://b/", big), (2, "http://b/", big), (3, None, None), (4, "http://c\r\nd", ""), (None, "http://e", "small"), (5, "http://f", "small"), (6, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int")
    warc.write_archives(pages, str(tmp_path / "w"), pages_per_file=2)
    records = warc.read_archives(spark, str(tmp_path / "w"))
    assert records.count() == 3 * len(rows)
    found = warc.assemble(records).collect()
    assert len(found) == len(rows) and all(r["request"] and r["metadata"] for r in found)
    for r in found:
        if r["response"]["type"] == "response":
            assert hashlib.sha1(r["response"]["payload"]).hexdigest() == r["response"]["payload_digest"]
    ids = Counter((r["metadata"]["fields"].get("page-id"), r["response"]["type"], r["metadata"]["fields"].get("refers-to-page-id")) for r in found)
    assert ids == Counter([("1", "revisit", "2"), ("2", "revisit", "2"), ("2", "response", None), ("3", "response", None), ("4", "response", None), (None, "response", None), ("5", "response", None), ("6", "response", None)])
    html = {r["metadata"]["fields"].get("page-id"): r["response"]["payload"] for r in found if r["response"]["type"] == "response"}
    assert html["2"] == big.encode() and html["3"] == b"" and html["6"] == b"y" * 300_000


def raw_record(kind, record_id, block, more=""):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id}\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """A gzip member for each record, blocks that end in line ends or hold empty lines, chunks of any length, faults."""
    import gzip

    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\n\r\n</p>\r\n"
    made = [raw_record("warcinfo", "<w>", b""), raw_record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r>\r\n"), raw_record("response", "<r>", body), raw_record("metadata", "<m>", b"via: x\r\n", "WARC-Concurrent-To: <r>\r\n"), raw_record("metadata", "<alone>", b"")]
    whole = b"".join(made)
    for size in (1, 3, 7, 10_000):
        assert [h["warc-record-id"] for h, _ in warc.parse(whole[i : i + size] for i in range(0, len(whole), size))] == ["<w>", "<q>", "<r>", "<m>", "<alone>"]
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in made))
    (tmp_path / "good" / "b.warc.gz").write_bytes(gzip.compress(whole.replace(b"<r>", b"<s>")))
    assert warc.read_archives(spark, str(tmp_path / "good")).count() == 10
    found = {r["capture_id"]: r for r in warc.assemble(warc.read_archives(spark, str(tmp_path / "good"))).collect()}
    assert set(found) == {"<r>", "<s>"} and found["<r>"]["metadata"]["fields"] == {"via": "x"} and found["<s>"]["request"]["record_id"] == "<q>"
    assert found["<r>"]["response"]["payload"] == b"<p>\r\n\r\n\r\n</p>\r\n" and found["<r>"]["response"]["payload_digest"] == hashlib.sha1(b"<p>\r\n\r\n\r\n</p>\r\n").hexdigest()
    for name, data in (("cut", gzip.compress(whole[:-60])), ("torn", gzip.compress(made[0]) + gzip.compress(made[1])[:-30]), ("junk", gzip.compress(made[0] + b"no record\r\n\r\nx"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(data)
        with pytest.raises(Exception, match=r"(?s)a\.warc\.gz|EOF|Unexpected end"):
            warc.read_archives(spark, str(tmp_path / name)).count()
        assert warc.read_archives(spark, str(tmp_path / name), strict=False).count() >= 1


def test_a_page_of_100_megabytes(spark, tmp_path):
    pages = spark.range(3).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "repeat('0123456789', CASE WHEN id = 1 THEN 10500000 ELSE 100 END) AS html")
    pages.repartition(1).write.parquet(str(tmp_path / "p"))
    warc.write_archives(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "w"))
    found = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"), payloads=False)).select("metadata.fields", "response.payload_bytes", "response.type").collect()
    assert sorted((r["fields"]["page-id"], r["payload_bytes"], r["type"]) for r in found) == [("0", 1000, "revisit"), ("1", 105_000_000, "response"), ("2", 1000, "response")]


def test_pieces_are_lossless_and_seeded(edge, edge_rows):
    model = token_counts.tokenizer_path(piece_sampling.MODEL)
    made = piece_sampling.encode(edge, model)
    back = piece_sampling.decode(made, model, "pieces_", "text")
    assert made.columns == [*edge.columns, "pieces_"] and back.columns == [*made.columns, "text_"]
    rows = back.selectExpr("doc_id", "text", "pieces_ AS ids", "text_ AS again").collect()
    assert len(rows) == len(edge_rows) and all((r["text"] or "") == r["again"] for r in rows)
    other = piece_sampling.encode(edge.repartition(5), model, name="ids").select("doc_id", "text", "ids").collect()
    as_key = lambda r: key((r["doc_id"], r["text"], tuple(r["ids"])))
    assert sorted(map(as_key, rows)) == sorted(map(as_key, other))
    assert {tuple(r["ids"]) for r in piece_sampling.encode(edge.where("doc_id = 8"), model, seed=1, name="ids").collect()} != {tuple(r["ids"]) for r in rows if r["doc_id"] == 8}


def test_pieces_have_the_lattices_distribution():
    import math

    import numpy as np

    lattice = piece_sampling.Lattice(token_counts.tokenizer_path(piece_sampling.MODEL), 0.8)
    ids, at = lattice.sample([" hello"] * 20_000, np.arange(20_000))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:]))
    weight = {int(i): float(w) for index, names, weights in lattice.by_length for i, w in zip(names, weights)}
    spelled = {lattice.bytes_of[i].decode(): i for i in weight}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in spelled:
                yield from ((spelled[s[:k]], *rest) for rest in ways(s[k:]))

    chance = {w: math.exp(sum(weight[i] for i in w)) for w in ways(" hello")}
    total = sum(chance.values())
    for w, p in chance.items():
        assert abs(seen[w] / 20_000 - p / total) < 5 * math.sqrt(max(p / total, 1e-4) / 20_000)


def test_classifiers_on_edges(edge, edge_rows, labels):
    for module in (toxicity, quality_classifier):
        made = module.scored(edge, module.fit(edge, labels, module.learnable()))
        # the table has a column score already
        assert made.columns[: len(edge.columns)] == edge.columns and made.columns[-1] == "score_" and len(set(made.columns)) == len(made.columns)
        found = made.collect()
        assert len(found) == len(edge_rows) and all(0 <= r["score_"] <= 1 for r in found)
        assert len({r["score_"] for r in found if not WORD.findall(r["text"] or "")}) == 1
        no_labels = module.fit(edge, labels.where("false"), module.learnable())
        assert {r["score_"] for r in module.scored(edge, no_labels).collect()} == {0.0}


def plain_kneser_ney(words, counts, word, order=6, unseen=1e-5, off=2.0):
    """Both classes' log-likelihoods of a word by dictionaries: the definition, letter by letter."""
    import math

    kinds, sums, longest = [defaultdict(set) for _ in range(order + 1)], [Counter() for _ in range(order + 1)], [[Counter() for _ in range(order + 1)] for _ in (0, 1)]
    for w, (a, b) in zip(words, counts):
        f = f"<{w}>"
        for end in range(1, len(f) + 1):
            for n in range(1, min(order, end) + 1):
                gram = f[end - n : end]
                if n < order and end > n:
                    kinds[n][gram].add(f[end - n - 1])
                if n == order or end == n:
                    sums[n][gram] += a + b
                    longest[0][n][gram] += a
                    longest[1][n][gram] += b
    shared = [Counter() for _ in range(order + 1)]
    for n in range(1, order + 1):
        for gram in set(kinds[n]) | set(sums[n]):
            shared[n][gram] = sums[n][gram] if n == order or gram[0] == "<" else len(kinds[n][gram])
            if n == 1 and gram == "<":
                shared[n][gram] = 0
    d = []
    for n in range(order + 1):
        ones, twos = sum(v == 1 for v in shared[n].values()), sum(v == 2 for v in shared[n].values())
        d.append(min(max(ones / max(ones + 2 * twos, 1) if ones else 0.5, 0.1), 0.9))

    def of(counter, n, context):
        return {g: v for g, v in counter[n].items() if g[:-1] == context and v > 0}

    def interpolated(n, gram):
        if n == 0:
            return unseen
        context = gram[:-1]
        own = of(shared, n, context)
        if n > 1 and not any(context in x for x in (shared[n - 1],)):
            return interpolated(n - 1, gram[1:])
        total = sum(own.values())
        if not total:
            return interpolated(n - 1, gram[1:])
        backoff = sum(min(v, d[n]) for v in own.values()) / total if n > 1 else 1.0
        return max(own.get(gram, 0) - d[n], 0) / total + backoff * interpolated(n - 1, gram[1:])

    f, out = f"<{word}>", []
    for c in (0, 1):
        log = 0.0
        for end in range(2, len(f) + 1):
            n = min(order, end)
            gram = f[end - n : end]
            own = of(longest[c], n, gram[:-1])
            total, p = sum(own.values()), interpolated(n, gram)
            if total:
                p = max(own.get(gram, 0) - off, 0) / total + sum(min(v, off) for v in own.values()) / total * p
            log += math.log(p)
        out.append(log)
    return out


def test_kneser_ney_against_dictionaries():
    import numpy as np

    words = ["idiot", "idiots", "ideal", "dear", "trash", "ash", "a", "thrash", "rash", "deal", "xx"]
    counts = np.array([[0, 5], [1, 4], [6, 0], [3, 3], [0, 7], [4, 1], [9, 9], [2, 2], [0, 1], [5, 1], [1, 0]])
    model = toxicity.KneserNey.fit(words, counts)
    asked = [*words, "idiotic", "trashed", "qqq", "de", "thrashes"]
    found = model.words(asked)
    for w, row in zip(asked, found):
        assert row[:2] == pytest.approx(plain_kneser_ney(words, counts.tolist(), w), rel=1e-4) and row[2] == len(w) + 1


def test_toxicity_features_against_plain_ones():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 60, 900):
        words = [f"w{i}" for i in rng.integers(0, n, n)]
        words += words[:3]
        of = {w: (-rng.random() * 20, -rng.random() * 20, 1.0 + rng.integers(1, 9)) for w in dict.fromkeys(words)}
        found = toxicity.text_features(words, np.array([of[w] for w in words]))
        toxic_first = sorted(of.values(), key=lambda v: v[0] - v[1])[: max(math.ceil(toxicity.TOP_SHARE * len(of)), toxicity.TOP_LEAST)]
        per_character = lambda some: sum(t - o for o, t, _ in some) / sum(n for *_, n in some)
        every = [of[w] for w in words]
        clear = sum(min(max(t - o - toxicity.MARGIN, 0), toxicity.REACH) for o, t, _ in of.values()) / (sum(v[2] for v in every) + toxicity.SHORT)
        expect = [per_character(every), per_character(toxic_first), clear]
        assert found[2:] == pytest.approx(expect) and found[1] - found[0] == pytest.approx(found[2])
    assert toxicity.text_features([], np.zeros((0, 3))) == (0.0,) * toxicity.FEATURES


def test_shared_counts_cover_all_texts(edge, edge_rows):
    words = ["one", "two", "same", "日本語", "nowhere", ""]
    expect = [sum(w in (t or "").lower().split() for _, t, *_ in edge_rows) for w in words]
    assert toxicity.corpus_counts(edge, words).tolist() == expect and expect[0] == 5 and expect[4:] == [0, 0]


def test_forest_against_plain_paths():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    forest = quality_rules.Forest.grow(x, trees=20)

    def path(row, root):
        at = root
        while forest.feature[at] >= 0:
            at = forest.left[at] + (row[forest.feature[at]] >= forest.value[at])
        return forest.path[at]

    c = 2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256
    for row, score in zip(x[:40], forest.score(x[:40])):
        assert score == pytest.approx(2 ** (-np.mean([path(row, r) for r in forest.roots]) / c))


def test_quality_scores_against_a_plain_forward_pass(spark, edge, edge_rows, labels):
    """Each word's features one by one: mean of the weights over all features of the text, then the logistic function."""
    import math

    import numpy as np

    model = quality_classifier.fit(edge, labels, quality_classifier.learnable())
    assert model.weights is not None
    for r in quality_classifier.scored(edge.where("doc_id > 15").select("doc_id", "text"), model).collect():
        words = (r["text"] or "").split()
        if not words:
            continue
        total, n = 0.0, 0
        for at, w in enumerate(words):
            ids, _ = quality_classifier.word_features([w])
            total, n = total + sum(model.weights[i] for i in ids), n + len(ids)
            for k in range(1, 5):
                if at >= k and w == words[at - k]:
                    total, n = total + model.weights[quality_classifier.BUCKETS - k], n + 1
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-np.clip(total / n + model.shift, -30, 30))), rel=1e-6)


@pytest.mark.parametrize(("sf", "loss"), [("0.001", 0.69), ("0.01", 0.2), ("0.1", 0.06)])
def test_quality_training_converges(spark, sf, loss):
    """Bounded weights, held-out log loss, and scores that are no bare 0 or 1, at three scales."""
    import numpy as np

    d = f"/root/testdata/sf{sf}"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality_classifier.fit(docs, labels, quality_classifier.learnable())
    assert np.abs(model.weights).max() < 100 and np.isfinite(model.loss)
    rows = quality_classifier.scored(docs, model).join(labels, "doc_id", "left").withColumn("held", ~quality_classifier.learnable()).toPandas()
    assert (np.abs(np.log(rows["score"] / (1 - rows["score"]))) > 29).mean() < 0.01
    held = rows[rows["held"] & rows["quality"].notna()]
    p = np.where(held["quality"] == 1, held["score"], 1 - held["score"])
    assert -np.log(p).mean() < loss


def test_models_count_all_texts_and_labelled_rows(spark, tmp_path):
    """Spark's counts make the model that all words at hand make: more rows of a class than any sample had, texts without a label too."""
    import numpy as np

    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("ab<") + rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice(["", ".", "é"]) for _ in range(6))) for i in range(3_600)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([*rows, (9_999, None)], "doc_id long, text string").repartition(3).write.parquet(path)
    docs, marked = spark.read.parquet(path), spark.createDataFrame([(i, i % 2) for i in range(2_600)], "doc_id long, toxic int")
    taught, sizes = toxicity.labelled_rows(docs, marked, "toxic", F.lit(True))
    assert sizes == {0: 1300, 1: 1300} and taught.count() == 2600
    grams = toxicity.counted_grams(docs, taught)
    counts = {}
    for i, text in rows:
        for w in set(text.split()):
            of = counts.setdefault(w, [0, 0, 0])
            of[0] += 1
            if i < 2_600:
                of[1 + i % 2] += 1
    n = np.array(list(counts.values()))
    asked = [*counts, "abba", "zz"]
    plain = toxicity.KneserNey.fit(list(counts), n[:, 1:], (1.0, 4.0), n[:, 0])
    assert toxicity.collected(grams).model((1.0, 4.0)).words(asked) == pytest.approx(plain.words(asked), rel=1e-5)
    # with few keys n-grams share them, and every count is still there
    few = toxicity.collected(grams, 64)
    assert few.counts.sum() == toxicity.collected(grams).counts.sum() and len(few.keys) <= 6 * 64
    assert np.isfinite(few.model((2.0,)).words(asked)).all()


def test_driver_keeps_class_counts_of_counted_grams_alone(spark):
    """Most n-grams are of no class: the driver holds no counts for them, and leaving out a fold still takes off its own."""
    import numpy as np

    docs = spark.createDataFrame([(i, f"plain{i:03} words{i % 7} here{i % 5}") for i in range(200)], "doc_id long, text string")
    marked = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    rows, _ = toxicity.labelled_rows(docs, marked, "toxic", F.lit(True))
    counted = toxicity.collected(toxicity.counted_grams(docs, rows))
    assert counted.counts.any(1).all() and len(counted.counts) == len(counted.counted) < len(counted.keys) / 2
    start = counted.counts[counted.parent[counted.counted] < 0].sum(0)  # every word starts with the frame
    kinds = rows.collect()
    of = lambda fold, label: sum(len(r["text"].split()) for r in kinds if (r["fold"], r["label"]) == (fold, label))
    assert start.tolist() == [of(f, c) for f in range(toxicity.FOLDS) for c in (0, 1)]
    for fold in range(toxicity.FOLDS):
        assert np.isfinite(counted.model((1.0,), fold).words(["plain000", "zzz"])).all()


def test_driver_sends_models_without_a_second_copy(spark, edge, labels, monkeypatch):
    """What is broadcast is the model itself, which Spark writes to a file, and not bytes that the driver holds beside it."""
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(type(value)) or send(self, value))
    model = toxicity.fit(edge, labels, toxicity.learnable())
    assert toxicity.scored(edge, model).count() == edge.count()
    assert toxicity.ToxicityModel in sent and not {bytes, bytearray} & set(sent)


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_texts_are_scored_together_as_one_by_one(monkeypatch, most):
    """Texts of one batch share their words' likelihoods; features are those of each text, even if the kept words start afresh within a batch."""
    import numpy as np

    from driftline.llm import words as W

    monkeypatch.setattr(W, "BLOCK", 300)
    rng = random.Random(5)
    value = lambda w: (-1.0 - len(w) % 3 - ord(w[0]) % 5 if w else -1.0, -1.0 - ord(w[-1]) % 7 if w else -2.0, len(w) + 1.0)
    asked = []
    kept = W.CodedTable(lambda words: asked.append(words) or np.array([value(w) for w in words]), most)
    texts = [" ".join(rng.choice(["", "\u201e", "<"]) + rng.choice("abcdefé日") * rng.randint(1, 3) + rng.choice(["", ",", "..."]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [None, "", " \n\u00a0", "...", texts[3], "\u0130STANBUL"]
    found = toxicity.features(texts, kept, 1)
    for text, row in zip(texts, found, strict=True):
        split = toxicity.split(text)
        expect = toxicity.text_features(split, np.array([value(w.strip(toxicity.EDGE)) for w in split]).reshape(-1, 3))
        assert row == pytest.approx(expect, rel=1e-12, abs=1e-12)
    assert all(w == w.strip(toxicity.EDGE) and len(ws) == len(set(ws)) for ws in asked for w in ws)
    assert found[3].tolist() == found[-2].tolist()


def test_word_tables_that_start_afresh_know_all_words_asked():
    """Known and new words of one text that together are more than the table keeps."""
    import numpy as np

    from driftline.llm.words import WordTable

    kept = WordTable(lambda words: np.array([[float(len(w))] for w in words]), 5)
    kept(["a", "bb", "ccc", "dddd"])
    both = ["a", "bb", "ccc", "dddd", "e" * 5, "e" * 6, "e" * 7]
    assert kept(both)[:, 0].tolist() == [float(len(w)) for w in both]


@pytest.mark.parametrize("most", [2, 400_000])
def test_word_counts_by_kind(spark, most):
    """In how many texts of each kind a word is, however often it was passed on; of two forms of a word a text counts for each."""
    texts = [("One, one two two", 0), ("two 日本, ...", 1), (None, 0), ("", 1), ("one\u2003TWO \U0001f600", 1), ("İx", 0)] * 3
    made = toxicity.word_counts(spark.createDataFrame(texts, "text string, kind int"), 2, toxicity.EDGE, most).groupBy("word").agg(F.sum("n0"), F.sum("n1"))
    expect = {}
    for text, kind in texts:
        for w in set((text or "").lower().split()):
            expect.setdefault(w.strip(toxicity.EDGE), [0, 0])[kind] += 1
    assert {r[0]: [r[1], r[2]] for r in made.collect()} == expect and expect["one"] == [6, 3]


def test_only_ngrams_are_shuffled(spark):
    """An n-gram's count is the sum of its words': one shuffle adds it up, and words are not shuffled before."""
    import numpy as np

    docs = spark.createDataFrame([(k, f"ab{k % 3} (cab), cab") for k in range(9)], "kind long, text string").selectExpr("kind % 2 AS kind", "text")
    made = toxicity.gram_counts(docs, ["a", "b"], 1, 2)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    found = {r[0]: tuple(r)[1:] for r in made.groupBy("gram").agg(F.max("initial"), F.sum("a"), F.sum("b")).collect()}
    n = np.array([[len(set(r["text"].split())) * (r["kind"] == k) for k in (0, 1)] for r in docs.collect()]).sum(0)
    assert found["<"] == (True, *n) and found["cab>"] == (False, 10, 8) and found["<ab0"] == (True, 2, 1)


def test_strings_of_code_points():
    import numpy as np

    from driftline.llm.words import strings

    words = ["ab", "é日", "x\U0001f600", "\x7f\x80", "\u07ff\u0800", "\uffff\U00010000"]
    assert strings(np.array([[ord(c) for c in w] for w in words], np.uint64)).to_pylist() == words


def test_kneser_ney_models_are_distributions():
    """Probabilities of all continuations of a context add up to no more than one, for the shared and each class's model."""
    import numpy as np

    texts = ["aab", "aba", "abb", "bab", "baa"]
    model = toxicity.KneserNey.fit(texts, np.array([[3, 1], [2, 0], [1, 4], [0, 2], [5, 0]]))
    logs = model.words([a + b + c for a in "ab" for b in "ab" for c in "ab"])
    assert np.isfinite(logs).all() and (logs[:, :2] < 0).all()
    total = np.exp(logs[:, :2]).sum(0)
    assert (total < 1.0 + 1e-6).all() and (total > 0.05).all()


def test_empty_tables(nothing, labels, tmp_path):
    path, model = token_counts.tokenizer_path(), token_counts.tokenizer_path(piece_sampling.MODEL)
    for df in (
        exact_dedup.exact_groups(nothing), exact_dedup.drop_copies(nothing), source_mix.mix_sources(nothing), source_mix.take_mix(nothing), minhash_dedup.near_duplicates(nothing), minhash_dedup.keep_one(nothing),
        quality_rules.judge(nothing, labels), token_counts.count_tokens(nothing, str(tmp_path / "c"), path), piece_sampling.round_trip(nothing, model),
        toxicity.scored(nothing, toxicity.fit(nothing, labels, toxicity.learnable())), quality_classifier.scored(nothing, quality_classifier.fit(nothing, labels, quality_classifier.learnable())),
    ):
        assert df.count() == 0
    pages = nothing.sparkSession.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.judge(pages, url_filters.train(url_filters.labelled_urls(nothing.sparkSession))).count() == 0
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.assemble(warc.read_archives(pages.sparkSession, str(tmp_path / "w"))).count() == 0


def test_bit_tables(spark):
    wanted = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    may, sure = split_by_bits(spark.range(1000).withColumnRenamed("id", "k"), "k", bit_table(wanted, "k"))
    assert {r["k"] for r in wanted.collect()} <= {r["k"] for r in may.collect()}
    assert may.count() + sure.count() == 1000 and sure.count() > 800
    many = spark.range(100_000).withColumnRenamed("id", "k")
    assert bit_table(many, "k").words.count() <= bit_table(many, "k").bits // 64
    exact, all_ = row_bit_table(wanted, "k"), spark.range(1000).withColumnRenamed("id", "k")
    assert {r["k"] for r in split_by_bits(all_, "k", exact)[0].collect()} == set(range(0, 1000, 7)) and row_bit_table(wanted, "k", most=2).bits
    assert {r["k"] for r in only_rows(all_, wanted, "k", "k").collect()} == set(range(0, 1000, 7))
    # beyond the bound there is no table, and all rows may be wanted
    crowded = bit_table(many, "k", most=64)
    may, sure = split_by_bits(many, "k", crowded)
    assert crowded.words is None and may.count() == 100_000 and sure.count() == 0


def test_row_keys_do_not_change_with_the_number_of_slots(spark, tmp_path):
    """The same rows have the same keys in scans that Spark splits otherwise, and the right rows are dropped then."""
    spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id % 4000) AS text", "'x' AS file_").repartition(32).write.parquet(str(tmp_path / "d"))
    keyed = with_row_keys(spark.read.parquet(str(tmp_path / "d")), "tag")
    assert keyed.columns == ["doc_id", "text", "file_", "tag"]
    split, keys = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(split)
    for size in (before, "4000", "1500"):
        spark.conf.set(split, size)
        again = keyed.select("doc_id", "tag")  # planned anew
        keys.append(({r["doc_id"]: r["tag"] for r in again.collect()}, again.rdd.getNumPartitions()))
    kept = exact_dedup.drop_copies(spark.read.parquet(str(tmp_path / "d")))
    spark.conf.set(split, before)  # planned with small splits, run with large ones
    assert sorted(r["text"] for r in kept.collect()) == sorted({f"text {i % 4000}" for i in range(5000)})
    assert len({n for _, n in keys}) > 1 and keys[0][0] == keys[1][0] == keys[2][0] and len(set(keys[0][0].values())) == 5000


def test_row_keys_of_rows_that_are_no_files(spark, edge):
    """Made rows, and rows that a join repeats, are stored first."""
    for docs in (spark.range(10).withColumnRenamed("id", "doc_id"), edge.select("doc_id").crossJoin(spark.range(2))):
        keyed = staged(with_row_keys(docs, "tag"), "keyed")
        assert keyed.count() == docs.count() == keyed.select("tag").distinct().count()


def test_rows_that_stand_in_for_others_are_found(spark, tmp_path):
    """As many rows as the file has, with the same sum of places, some of them twice: keys are made of stored rows then."""
    path = str(tmp_path / "d")
    spark.range(0, 1000, 1, 1).withColumnRenamed("id", "doc_id").write.parquet(path)
    docs = spark.read.parquet(path)
    places = lambda df: df.selectExpr("1 AS file_", "_metadata.row_index AS place_")
    twice = docs.where("doc_id not in (1, 2)").unionByName(docs.where("doc_id in (0, 3)"))
    places_twice = places(docs.where("doc_id not in (1, 2)")).unionByName(places(docs.where("doc_id in (0, 3)")))
    assert twice.count() == 1000 and places_twice.selectExpr("sum(place_)").first() == places(docs).selectExpr("sum(place_)").first()
    assert whole_files(places(docs)) and not whole_files(places_twice) and not whole_files(places(docs.where("doc_id < 900 or doc_id = 950")))
    assert whole_files(places(docs.where("false")))
    for some in (docs.where("doc_id % 3 = 1"), docs.join(spark.range(2).hint("broadcast"), F.lit(True)).where("id = 0 or doc_id < 10").drop("id"), twice):
        keyed = staged(with_row_keys(some, "tag"), "keyed")
        assert keyed.count() == some.count() == keyed.select("tag").distinct().count()


def test_inner_nodes_keep_about_one_common_path_a_level():
    """Six levels of branching lose no share of the pairs of similarity 0.8 that 16 trees would not make up for."""
    import numpy as np

    rng = np.random.default_rng(2)
    pairs = 500
    one = rng.integers(0, 1 << 16, (pairs, minhash_dedup.TOKENS), dtype=np.uint16)
    other = np.where(rng.random(one.shape) < 0.8, one, rng.integers(0, 1 << 16, one.shape, dtype=np.uint16))
    tokens, row = np.concatenate([one, other]), np.arange(2 * pairs)
    node = minhash_dedup.mix(np.arange(1, pairs + 1, dtype=np.uint64))[row % pairs]
    for _ in range(6):
        node, at = minhash_dedup.descend(node, tokens[row])
        row = row[at]
    paths = set(zip(node[row < pairs].tolist(), row[row < pairs].tolist())) & {(n, r - pairs) for n, r in zip(node[row >= pairs].tolist(), row[row >= pairs].tolist())}
    assert 0.8 < len(paths) / pairs < 1.3
    assert len({r for _, r in paths}) / pairs > 0.4


def test_isolated_pairs_in_a_family(spark, tmp_path):
    """Sets that no level parts (0.7 alike), and pairs (0.82) that are linked to each other alone: all pairs are found."""
    import random

    rng = random.Random(3)
    core = [f"c{i}" for i in range(82)]
    rows = []
    for p in range(60):
        for side in "ab":
            rows.append((len(rows), " ".join(core + [f"p{p}w{i}" for i in range(8)] + [f"{side}{p}w{i}" for i in range(10)])))
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = minhash_dedup.classes(with_row_keys(spark.read.parquet(str(tmp_path / "d")), "tag"), 1, node=10).collect()
    assert Counter(Counter(r["root"] for r in found).values()) == {2: 60}
    by = defaultdict(set)
    for r in found:
        by[r["root"]].add(r["doc_id"] // 2)
    assert all(len(x) == 1 for x in by.values())


def test_pairs_in_a_family_beyond_a_node(spark, tmp_path):
    """Default parameters: 1,200 sets 0.5 to 0.7 alike, more than a node compares, with 300 isolated pairs (0.82) among them."""
    import random

    rng = random.Random(8)
    rows, core = [], [f"c{i}" for i in range(70)]
    for p in range(600):
        own = [f"p{p}w{i}" for i in range(20)]
        for side in "ab":
            rows.append((len(rows), " ".join(core + (own if p < 300 else [f"{side}{w}" for w in own]) + [f"{side}{p}x{i}" for i in range(10)])))
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = minhash_dedup.classes(with_row_keys(spark.read.parquet(str(tmp_path / "d")), "tag"), 1).collect()
    by = defaultdict(set)
    for r in found:
        by[r["root"]].add(r["doc_id"])
    wanted = {frozenset((2 * p, 2 * p + 1)) for p in range(300)}
    linked = {frozenset(x) for x in by.values() if len(x) > 1}
    assert linked <= wanted and len(linked) == len(wanted)


def test_all_pairs_of_an_unparted_node_meet(spark):
    """All but those inside the node's largest component."""
    large = spark.createDataFrame([(7, r, 0 if r < 25 else r) for r in range(60)], "node long, rep long, root long")
    met = defaultdict(set)
    for r in minhash_dedup.crossed(large, minhash_dedup.outside(large), 16).collect():
        met[r["node"]].add(r["rep"])
    pairs = {(a, b) for x in met.values() for a in x for b in x if a < b}
    assert {(a, b) for b in range(25, 60) for a in range(b)} <= pairs
    assert max(map(len, met.values())) < 40


def test_more_n_grams_than_tasks_look_up_make_the_same_model(spark, edge, tmp_path):
    """Beyond the n-grams that tasks may hold none is merged with another: tables give the model, the curve and the scores of all of them."""
    import numpy as np

    rng = random.Random(13)
    word = lambda k: rng.choice("ab<") + rng.choice("abcdefgh") * rng.randint(1, 4) + ("vile" if k % 2 and rng.random() < 0.3 else rng.choice(["", ".", "é"]))
    rows = [*((i, " ".join(word(i) for _ in range(rng.randint(1, 40)))) for i in range(900)), (900, None), (901, " \n"), (901, "again ..."), (902, "ab " * 3000)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    docs, marked = spark.read.parquet(path), spark.createDataFrame([(i, i % 2) for i in range(700)], "doc_id long, toxic int")
    whole, wide = (toxicity.fit(docs, marked, toxicity.learnable(), most) for most in (toxicity.MOST_GRAMS, 64))
    assert isinstance(wide.models, toxicity.TableModel) and isinstance(whole.models, toxicity.KneserNey)
    assert wide.share == whole.share and wide.beta == pytest.approx(whole.beta, abs=1e-4) and wide.middle == pytest.approx(whole.middle, abs=1e-5)
    asked = ["ab", "avile", "zz", "", "ahhq", "qvile", "ñ"]
    known = {asked[r["id"]]: r["v"] for r in wide.models.values(spark.createDataFrame(list(enumerate(asked)), "id long, word string")).collect()}
    assert np.array([known[w] for w in asked]) == pytest.approx(whole.models.words(asked), rel=1e-5)
    # rows of other texts too, with words that no text had
    other = docs.unionByName(spark.createDataFrame([(2000, "new wörds <avile>"), (2001, "ab?!")], docs.schema)).withColumn("chunk_", F.col("doc_id"))
    key = lambda made: sorted((r["doc_id"], r["text"] or "", r["chunk_"], *(round(r[c], 5) for c in toxicity.ADDED)) for r in made.collect())
    first, second = key(toxicity.scored(other, whole)), key(toxicity.scored(other, wide))
    assert len(first) == len(second) == len(rows) + 2
    for a, b in zip(first, second):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-3)
    assert toxicity.scored(edge, wide).count() == edge.count()
