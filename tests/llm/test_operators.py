"""Each operator against a brute-force version on a small table, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelix.llm import decontaminate, jaccard_tiles, language_id, line_chunks, pii_crf, quality_rules, queries, rule_ensemble, segment_samples, token_files, warc_index
from allelix.llm.common import crc_part

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 1 personal data


def regex_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        s = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_patterns():
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choices("0123.@+ -(aé%", k=r.randint(0, 45)))
        assert pii_crf.base_spans(t) == regex_spans(t), t


def test_field():
    field, known = pii_crf.train(pii_crf.labelled_sentences()), {}
    held = pii_crf.labelled_sentences(200, 77)
    found = field.decode([field.ids(w, known) for w, _ in held])
    right = sum([pii_crf.TAGS[t] for t in tags] == want for tags, (_, want) in zip(found, held, strict=True))
    assert right >= 0.95 * len(held)


def test_personal_data(spark, texts, odd, none):
    got = {r["doc_id"]: r for r in queries.op1_pii_crf(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = regex_spans(t)
        joined = ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii_crf.KINDS[:4]] == [sum(x[1] == n for x in want) for n in range(4)]
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))
        if 'token = "' in t:
            assert "secret" in got[i]["spans"]
    rows = pii_crf.personal_data(odd).collect()
    assert len(rows) == 13 and sum(r["n_email"] for r in rows) == 1 and pii_crf.personal_data(none).count() == 0


# ---- 2 quality rules


def brute_repeats(words):
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    return longest


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(300):
        docs = [" ".join(r.choices("abc"[: r.randint(1, 3)], k=r.randint(0, 30))) for _ in range(3)]
        words = quality_rules.Words(pa.array(docs))
        longest = quality_rules.repeats(words.coded()[0], words.doc, words.first)[0]
        for d, t in enumerate(docs):
            assert longest[words.first[d] : words.first[d + 1]].tolist() == [x if x >= 3 else 0 for x in brute_repeats(t.split())]


def rule_row(t, limits=quality_rules.Limits()):
    words = WORD.findall(t or "")
    n = len(words)
    grams = Counter(tuple(words[k : k + 3]) for k in range(n - 2))
    inside = {k + j for k in range(n - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    failed = n < 50 or 100 * len(inside) > 50 * n
    longest = brute_repeats(words) if n < 400 else None
    kept = None
    if longest is not None:
        cover = {k + j for k in range(n) if longest[k] >= limits.min_repeat for j in range(longest[k])}
        kept = not failed and 100 * len(cover) <= limits.covered_percent * n and max(longest, default=0) <= limits.longest
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside), failed), kept


def test_quality_rules(spark, texts, odd, none):
    for r in queries.op2_quality_rules(spark, SF).collect():
        want, kept = rule_row(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert kept is None or r["kept"] == kept
    got = quality_rules.quality_rules(odd).collect()
    assert len(got) == 13 and not any(r["kept"] for r in got)
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.quality_rules(none).count() == 0


# ---- 3 and 4 classifiers


def test_rule_ensemble(spark, odd, none):
    got = {r["doc_id"]: r for r in queries.op3_rule_ensemble(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert sum(got[i]["predicted"] == labels[i] for i in held) >= 0.95 * len(held)
    labelled = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    part = crc_part(F.col("doc_id"))
    assert rule_ensemble.quality_scores(odd, labelled.where("quality = 1"), F.lit(True), part == 1).count() == 13
    assert rule_ensemble.quality_scores(none, labelled, F.lit(True), part == 1).count() == 0
    assert rule_ensemble.paths("If (feature 0 <= 1.0)\n If (feature 0 <= 0.5)\n  Predict: 0.0\n Else (feature 0 > 0.5)\n  Predict: 1.0\nElse (feature 0 > 1.0)\n Predict: 0.0", ["x"]) == [(("x", "<=", 0.5),), (("x", "<=", 1.0),), (("x", "<=", 1.0), ("x", ">", 0.5)), (("x", ">", 1.0),)]


def test_languages(spark, odd, none):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)
    for n in (2, 3, 4, 5, 9):
        code = language_id.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1 and len({tuple(c) for c in code.tolist()}) == n
    part = crc_part(F.col("doc_id"))
    mixed = odd.withColumn("lang", F.when(F.col("doc_id") > 5, "fr").otherwise(F.col("lang")))
    for df, most in ((mixed, 2), (odd, 1), (odd.withColumn("lang", F.lit(None).cast("string")), 0)):
        rows = language_id.languages(df, F.lit(True), part == 1).collect()
        assert len(rows) == 13 and len({r["lang_pred"] for r in rows} - {"und"}) <= most
        assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (2, 3, 7, 9))
    assert language_id.languages(none, F.lit(True), part == 1).count() == 0


# ---- 5 segmentations


@pytest.mark.parametrize("block", [512, 3])
def test_samples_follow_the_lattice(block, monkeypatch):
    monkeypatch.setattr(segment_samples, "BLOCK", block)
    path = queries.tokenizer_path("piece_bpe_32k.model")
    words = segment_samples.Vocabulary.at(path, 1.0)
    pieces = {b.decode().replace(" ", segment_samples.MARK): i for i, b in enumerate(words.bytes) if i > 258}

    def every(s):
        if not s:
            return [((), 0.0)]
        out = []
        for n in range(1, min(16, len(s)) + 1):
            if s[:n] in pieces:
                own = ((pieces[s[:n]],), words.weight[pieces[s[:n]]])
            elif n == 1:
                own = (tuple(3 + b for b in s[0].encode()), words.byte_weight * len(s[0].encode()))
            else:
                continue
            out += [(own[0] + ids, own[1] + w) for ids, w in every(s[n:])]
        return out

    text = "the\ncat 𝄞"
    found = every(segment_samples.MARK + text.replace(" ", segment_samples.MARK))
    total = np.logaddexp.reduce([w for _, w in found])
    log = {ids: w - total for ids, w in found}
    n, k = 6000, 3
    firsts, counted = Counter(), Counter()
    for paths, threshold, lattices in segment_samples.samples(pa.array([text] * n), segment_samples.mix(np.arange(n).astype(np.uint64)), words, k):
        ids = [tuple(words.expand(lattices.piece[p.edges]).tolist()) for p in paths]
        assert len(set(ids)) == k and paths[-1].value >= threshold
        firsts[ids[0]] += 1
        for x, p in zip(ids, paths, strict=True):
            assert log[x] == pytest.approx(p.log_prob)
            counted[x] += 1 / -math.expm1(-math.exp(p.log_prob - threshold))
    best = sorted(log, key=log.get)[-3:]
    for x in best:
        share = math.exp(log[x])
        assert abs(firsts[x] / n - share) < 4 * math.sqrt(share / n)
        assert counted[x] / n == pytest.approx(1, abs=0.15)
    few = segment_samples.samples(pa.array(["", "\n"]), np.arange(2).astype(np.uint64), words, 5)
    assert [len(f[0]) for f in few] == [1, 1]


def test_segmentations(spark, texts, odd, none):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = queries.op5_segment_samples(spark, SF).collect()
    assert all(r["round_trip"] for r in rows)
    per = defaultdict(set)
    for r in rows:
        per[r["doc_id"]].add(r["ids_crc32"])
    assert per.keys() == texts.keys() and all(len(per[i]) == 3 for i in texts if len(texts[i]) > 40)
    some = segment_samples.sampled_segmentations(odd, path, k=2, with_ids=True)
    back = segment_samples.decoded(some, path).collect()
    want = {t for t in (r["text"] or "" for r in odd.collect())}
    assert {r["ids"] for r in back} == want and all(r["round_trip"] for r in back)
    assert segment_samples.sampled_segmentations(none, path).count() == 0
    again = {(r["doc_id"], r["sample"]): r["ids_crc32"] for r in segment_samples.sampled_segmentations(spark.read.parquet(f"{SF}/documents.parquet").repartition(7), path).collect()}
    assert again == {(r["doc_id"], r["sample"]): r["ids_crc32"] for r in rows}


# ---- 6 line chunks


def cut_lines(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:13], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if (h[i] ^ ((h[i - 1] if i else 0) >> 1)) % 4 == 0 or i == len(lines) - 1:
            out.append((start, i + 1 - start, "\n".join(lines[start : i + 1])))
            start = i + 1
    return out


def test_line_chunks(spark, odd, none):
    r = random.Random(4)
    passage = [f"line {k} of a passage" for k in range(14)]
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(r.randint(0, 6))] + passage * r.randint(0, 2) + [f"end {i}"] * 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = set(), {}
    for i, t in rows:
        kept = []
        for _, n, c in cut_lines(t):
            if n == 1 or c not in seen:
                kept.append(c)
            if n > 1:
                seen.add(c)
        want[i] = "\n".join(kept)
    got = {x["doc_id"]: x["_kept"] for x in line_chunks.dedup_lines(df).collect()}
    assert {i: k["text"] for i, k in got.items()} == want
    assert sum(k["n_removed_lines"] for k in got.values()) > 100
    rows = line_chunks.dedup_lines(odd).collect()
    assert len(rows) == 13 and sum(x["text"] is None and x["_kept"]["text"] is None for x in rows) == 2
    assert line_chunks.without_repeats(odd).columns == odd.columns and line_chunks.dedup_lines(none).count() == 0


# ---- 7 Jaccard


def shingle_set(t, k):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)]) if words else frozenset()


def brute_components(rows, k, percent):
    ids = [i for i, _ in rows]
    own = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(ids)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] and own[j] and 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for x in range(len(ids)):
        least[top(x)] = min(least.get(top(x), ids[x]), ids[x])
    return {ids[x]: (len(own[x]), least[top(x)]) for x in range(len(ids))}


@pytest.mark.parametrize(("k", "percent", "tile", "bits"), [(3, 90, 3000, 64), (5, 80, 3, 3), (2, 50, 3000, 64)])
def test_jaccard(spark, k, percent, tile, bits):
    r = random.Random(k)
    vocabulary = [f"w{x}" for x in range(300)]
    base = [r.choices(vocabulary, k=r.choice((4, 12, 40, 90, 150))) for _ in range(8)]
    rows = []
    for i in range(120):
        words = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 4, 7))):
            words[r.randrange(len(words))] = r.choice(vocabulary).upper()
        rows.append((i, " ".join(words)))
    rows += [(200, ""), (201, "a"), (202, "A"), (203, "\t")]
    rows += [(300 + n, " ".join(f"cut{x}" for x in range(n))) for n in (6, 7, 11, 12, 21, 22)]  # half of each other
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    join = jaccard_tiles.Join(words=k, percent=percent, tile_sets=tile, sig_bits=bits)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_tiles.jaccard_components(df, join=join).collect()}
    assert got == brute_components(rows, k, percent)


def test_jaccard_odd(odd, none):
    rows = jaccard_tiles.jaccard_components(odd).collect()
    assert len(rows) == 13 and all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0)
    assert {r["component_id"] for r in rows if r["doc_id"] is None and r["n_shingles"]} == {1}
    kept = jaccard_tiles.one_of_each(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 6").count() == 2
    assert jaccard_tiles.jaccard_components(none).count() == 0


# ---- 8 decontamination


def test_decontaminate(spark, texts, odd, none):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_decontaminate(spark, SF).collect()}
    plain = lambda t: " ".join(x for x in (re.sub(r"[\W_]+", "", w) for w in t.lower().split()) if x)
    exact = {(i, k) for i, t in texts.items() for k, x in items if f" {plain(x)} " in f" {plain(t)} "}
    assert exact <= got and len(got) <= len(exact) + 3
    r = random.Random(8)
    for rate, least in ((0.0, 1.0), (0.1, 0.97), (0.2, 0.93)):
        rows = []
        for k, x in items:
            words = x.split()
            for _ in range(int(rate * len(words))):
                at, kind = r.randrange(len(words)), r.randrange(3)
                words[at : at + (kind != 1)] = [] if kind == 2 else [f"new{r.randrange(10**6)}"]
            rows.append((k, " ".join(texts[k % 200].split()[:50] + words + texts[(k + 7) % 200].split()[:50])))
        found = {(x["doc_id"], x["item_id"]) for x in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert sum((k, k) in found for k, _ in items) >= least * len(items)
    bench = spark.createDataFrame([(1, "the dog sat on the log while it rained all day"), (2, None), (3, ""), (4, "a b"), (None, "no such words in any of these texts")], "item_id long, text string")
    hits = decontaminate.contamination(odd, bench).collect()
    short = {(1, 4), (None, 4)}  # items of any number of words are looked for
    assert {(h["doc_id"], h["item_id"]) for h in hits} == {(6, 1), (8, 1)} | short
    assert decontaminate.without_items(odd, bench).count() == 8 and decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).count() == 0
    two = decontaminate.contamination(odd, bench, plan=decontaminate.Plan(block_bytes=40))
    assert {(h["doc_id"], h["item_id"]) for h in two.collect()} == {(6, 1), (8, 1)} | short


def test_nearest():
    r = random.Random(3)
    for _ in range(200):
        item, text = [r.randrange(4) for _ in range(r.randint(1, 8))], [r.randrange(4) for _ in range(12)]

        def edit(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                row = [i] + [0] * len(b) if False else [i, *row[1:]] if False else _step(row, x, b, i)
            return row[-1]

        def _step(row, x, b, i):
            out = [i]
            for j, y in enumerate(b, 1):
                out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
            return out

        want = min(edit(item, text[a:b]) for a in range(13) for b in range(a, 13))
        got, _ = decontaminate.nearest(np.array(item, np.uint64), np.array([text], np.uint64), len(item))
        assert got[0] == want


# ---- 9 token files


def test_elias_fano():
    r = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 5, 5, 9], sorted(r.integers(0, 10**6, 5000).tolist()), list(range(3000)), [10**12]):
        e = token_files.EliasFano.load(token_files.EliasFano.of(np.array(values, np.int64)).dump())
        assert e.all().tolist() == values
        if values:
            assert e.select(np.arange(len(values))).tolist() == values
    dense = np.cumsum(r.integers(1, 200, 100_000))
    assert 8 * len(token_files.EliasFano.of(dense).dump()) < 11 * len(dense)


def test_encoder():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain, own = Tokenizer.from_file(path), token_files.Encoder(path)
    r = random.Random(5)
    rows = ["", " a b", "a  b", "a b ", "a\n b", "x <|endoftext|> y", "don't we'll", "　a b", "日本 語", "\x1c a"]
    rows += ["".join(r.choices("ab1.' \n\t sé日", k=r.randint(0, 40))) for _ in range(1500)]
    ids, count = own.encode(pa.array(rows))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [e.ids for e in plain.encode_batch(rows, add_special_tokens=False)]


def test_token_files(spark, texts, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain, start = Tokenizer.from_file(path), 0
    got = {r["doc_id"]: r for r in queries.op9_token_files(spark, SF).collect()}
    for i in sorted(texts):
        ids = [*plain.encode(texts[i], add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = token_files.read_token_files(token_files.write_token_files(odd, f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/odd", path), docs_at_once=2, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 8, 9] and all(r["ids"][-1] == 2 for r in rows)
    assert token_files.token_files(none, path).count() == 0
    manifest = spark.createDataFrame([(k, "p", 1, 0, k + 1, 1) for k in range(9)], token_files.MANIFEST)
    assert {r["shard"]: r["start"] for r in token_files.with_starts(manifest, group=2).collect()} == {k: k * (k + 1) // 2 for k in range(9)}


# ---- 10 WARC


def test_warc(spark, tmp_path):
    same, other = "<p>é</p>" * 300, "y" * 1000
    rows = [(1, "http://www.B.example.org:80/x?q#f", same), (5, "https://a.example.org/", same), (3, "https://a.example.org/", "small"), (4, None, "small"), (7, "no url", same), (8, "http://b.org/a b", None), (9, "http://b.org/", ""), (2, "http://c.org/", other), (None, "http://d.org/", other), (6, "http://d.org/", "x" * 999), (10, "http://d.org/", "x" * 999), (7, "no url", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("keeper", F.lit(2))
    directory = warc_index.write_archives(df, f"{tmp_path}/w", block_lines=2, shards=3)
    got = warc_index.read_archives(directory, with_payload=True).collect()
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    assert len(got) == len(rows)
    for r in got:
        h = next(x for x in groups if hashlib.sha1(x.encode()).hexdigest() == r["payload_digest"])
        top = max((i for i in groups[h] if i is not None), default=None)
        again = len(h.encode()) >= 1000 and len(groups[h]) > 1 and r["page_id"] != top
        assert (r["payload_bytes"], r["record_type"], r["refers_to"]) == (len(h.encode()), "revisit" if again else "response", top if again else None)
        assert r["payload"] == (b"" if again else h.encode())
    found = warc_index.look_up(directory, spark.createDataFrame([("https://a.example.org/",), ("http://d.org/",), ("http://none.org/",)], "url string")).collect()
    assert sorted((r["page_id"] or 0, r["url"]) for r in found) == [(0, "http://d.org/"), (3, "https://a.example.org/"), (5, "https://a.example.org/"), (6, "http://d.org/"), (10, "http://d.org/")]
    every = {(r["page_id"], r["url"], r["payload_digest"], r["record_type"]) for r in got}
    back = warc_index.archive_pages(df, f"{tmp_path}/again", block_lines=1, shards=2).collect()
    assert len(back) == len(rows) and {(r["page_id"], r["url"], r["payload_digest"], r["record_type"]) for r in back} == every
    long = spark.createDataFrame([(1, "http://a.org/", "é" * 2_000_000), (2, None, "é" * 2_000_000), (3, None, None)], "page_id long, url string, html string")
    assert {(r["page_id"], r["payload_bytes"], r["refers_to"]) for r in warc_index.archive_pages(long).collect()} == {(1, 4_000_000, 2), (2, 4_000_000, None), (3, 0, None)}
    assert warc_index.archive_pages(df.limit(0)).count() == 0
    key = spark.createDataFrame(rows[:1], "page_id long, url string, html string").select(warc_index.url_key(F.col("url"))).first()[0]
    assert key == "org,example,b,www)/x?q"


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["payload_digest"] for r in queries.op10_warc_index(spark, SF).collect()}
    assert got == {p["page_id"]: hashlib.sha1((p["html"] or "").encode()).hexdigest() for p in pages}
