"""Operators of codeloom.llm against brute force, round trips and edge cases."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ann, bitplane, bpe, kernels, ledger, licenses, minhash, packing, quality_lm, sharding, substring, tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, sig int, label int"


def words(text):
    return WORD.findall(text or "")


def odd_texts():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)] + ["Ünï", "日本", "😀", "a b", "x\x1cy"]
    base = [" ".join(rng.choice(vocab, n)) for n in (300, 300, 90, 40, 25, 3, 2, 1)]
    passage = " ".join(rng.choice(vocab, 60))
    out = [None, "", "  \n\t ", *base, base[0], base[0].replace("w7 ", "w8 ", 3), base[1] + " extra", base[1].upper(), base[2] + "\n" + passage, passage + " " + base[3], passage]
    out += ["same word " * 60, "\n".join(["a line of words"] * 9), "x" * 5000, base[0] + " " + base[0], "All rights\nreserved. Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "<|endoftext|> and <|startoftext|>", " lead", "trail ", "tab\tand \t mixed  spaces\r\nend"]
    for _ in range(25):
        w = base[0].split(" ")
        for i in rng.choice(len(w), 6, replace=False):
            w[i] = "n" + str(rng.integers(1000))
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", None if t is None else len(t), "k", 1, 2) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3)


CLASH = ", c0 int, c1 string, id string, again int, row string, tie int, at int, chunk string, hash int, rid int, key int, seeds int, gone int, __key string, __kept string, __slot int, __n int, trusted int, bits int, n_words string, kept string, text_a string"


@pytest.fixture(scope="module")
def hard(spark):
    """Repeated keys with equal and unlike texts, null keys and texts, a text of 9 MB, and columns of names that operators use."""
    rng = np.random.default_rng(8)
    vocab = [f"{'verylongword' * 3}{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    a, b, c, long = say(70), say(70), say(50), say(230_000)
    texts = [(1, a), (1, a), (1, a + " tail"), (2, a + " other end"), (2, b), (2, None), (3, b), (None, b), (None, b), (None, c), (None, None), (None, ""), (4, c + "\n" + c), (5, long), (6, long[:9000]), (-7, c), (8, "short one"), (8, "short one"), ((1 << 63) - 1, a)]
    extra = [None] * len(CLASH.split(",")[1:])
    rows = [(k, t, "en", "s", None if t is None else len(t), *extra) for k, t in texts]
    return spark.createDataFrame(rows, DOCS.replace(", key string, sig int, label int", "") + CLASH).repartition(4)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def both(odd, docs):
    return [({r.doc_id: r.text for r in d.select("doc_id", "text").collect()}, d) for d in (odd, docs)]


def test_rules(odd, docs, nothing):
    for texts, d in both(odd, docs):
        got = {r.doc_id: r for r in ledger.op3(d).collect()}
        assert len(got) == len(texts)
        for k, t in texts.items():
            w = words(t)
            lines = [x for x in (t or "").split("\n") if WORD.search(x)]
            at = {}
            for i in range(len(w) - 7):
                at.setdefault(tuple(w[i : i + 8]), []).append(i)
            cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
            r = got[k]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))
            assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
            assert not (r.base_failed and r.kept)
    assert ledger.op3(nothing).count() == 0


def test_ablation(odd):
    led = ledger.ledger(odd).cache()
    got = {r.rule: r for r in ledger.ablation(led, ledger.POLICIES[2]).collect()}
    bits = [r.fail_bits & ledger.POLICIES[2] for r in led.collect()]
    for rule in ledger.RULES:
        b = 1 << rule.bit
        assert (got[rule.name].n_failed, got[rule.name].n_only, got[rule.name].kept_without) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))


def brute_components(texts, n, percent):
    sets = {}
    for k, t in texts.items():
        w = [x.translate(AZ) for x in words(t)]
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return sets, {k: find(k) for k in sets}


def test_near_duplicates(odd, docs, nothing):
    for texts, d in both(odd, docs):
        for shingle, percent in ((3, 85), (5, 80)):
            sets, comp = brute_components(texts, shingle, percent)
            got = {r.doc_id: r for r in minhash.near_duplicates(d, shingle=shingle, percent=percent).collect()}
            assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(sets[k]), comp[k], comp[k] == k) for k in texts}
    assert minhash.op4(nothing).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=50)


def test_near_duplicates_of_repeated_keys(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    for shingle, percent in ((3, 85), (5, 80)):
        sets, comp = brute_components(dict(enumerate(t for _, t in rows)), shingle, percent)
        least = {c: min((rows[i][0] for i in comp if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp.values())}
        want = sorted((str(k), len(sets[i]), str(least[comp[i]]), least[comp[i]] == k) for i, (k, _) in enumerate(rows))
        got = minhash.near_duplicates(hard, shingle=shingle, percent=percent).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == want
    out = minhash.deduplicated(hard)
    assert out.dtypes == hard.dtypes
    stay = out.collect()
    assert len(stay) == len(set(comp.values())) and sorted(str(r.doc_id) for r in stay) == sorted(str(x) for x in least.values())


def test_near_duplicates_in_blocks(spark):
    """A star of near copies: the centre is not the smallest id, and copies are no links of each other."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(700):
        w = list(base)
        for p in rng.choice(len(w) // 6, 3, replace=False) * 6:
            w[p] = f"n{rng.integers(10**9)}"
        rows.append((i, " ".join(w)))
    rows.append((5000, " ".join(base)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    _, comp = brute_components(dict(rows), 3, 85)
    got = {r.doc_id: r.component_id for r in minhash.op4(d).collect()}
    assert got == comp


def text_hash(t):
    """What orders rows of one key."""
    raw = np.frombuffer((t or "").encode(), np.uint8)
    return int(kernels.run_hash(kernels.byte_prefix(raw), np.array([0]), np.array([len(raw)]))[0] >> np.uint64(1))


def brute_cuts(rows, n=20):
    """[(key, n_words, n_removed, what is left)] of rows (key, text), in the order of keys and texts."""
    again = Counter(k for k, _ in rows)
    seen, out = set(), []
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, text_hash(r[1]) if r[0] is None or again[r[0]] > 1 else 0)):
        w = words(t)
        gone, reach = np.zeros(len(w), bool), 0
        for i in range(len(w) - n + 1):
            x = hash(tuple(w[i : i + n]))
            if x in seen:
                gone[max(i, reach) : i + n] = True
                reach = i + n
            seen.add(x)
        out.append((k, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone.tolist(), strict=True) if not g)))
    return out


def test_substrings(odd, docs, hard, nothing):
    for d in (odd, docs, hard):
        rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        want = sorted((str(k), n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in brute_cuts(rows))
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.op8(d).collect()) == want
    assert substring.op8(nothing).count() == 0
    out = substring.deduplicated(hard)
    assert out.dtypes == hard.dtypes
    want = sorted((str(k), t) for k, _, m, t in brute_cuts([(r.doc_id, r.text) for r in hard.collect()]) if m)
    got = sorted((str(r.doc_id), r.kept) for r in substring.repeated(hard).collect())
    assert got == want
    untouched = [(k, m) for k, _, m, _ in brute_cuts([(r.doc_id, r.text) for r in hard.collect()]) if not m]
    assert len([1 for r in out.collect() if r.text is None or (r.doc_id, r.text) in {(x.doc_id, x.text) for x in hard.collect()}]) >= len(untouched)
    for r in substring.repeated(odd).collect():
        w = words({x.doc_id: x.text for x in odd.collect()}[r.doc_id])
        gone = {i for a, b in r.spans for i in range(a, b)}
        assert " ".join(x for i, x in enumerate(w) if i not in gone) == r.kept and len(gone) == r.n_removed


def test_bpe(odd, docs, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for texts, d in both(odd, docs):
        got = {r.doc_id: r for r in bpe.coded(d, path).collect()}
        for k, t in texts.items():
            ids = lib.encode(t or "", add_special_tokens=False).ids
            r = got[k]
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    full = bpe.coded(odd, path, digests=False)
    assert bpe.decoded(full.drop("decoded").where("n_tokens > 0"), path).join(full.select("doc_id", F.col("decoded").alias("d")), "doc_id").where("decoded <> d").count() == 0
    assert bpe.coded(nothing, path).count() == 0


def test_automaton_is_exact():
    """Merging by rank equals merging by rules for the byte-level tokenizer, as the automaton shows."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    assert tokens.by_rank(spec)
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_str(spec), tokens.Ids(spec, True)
    for t in odd_texts():
        assert list(np.frombuffer(own.ids(t or ""), own.dtype)) == lib.encode(t or "", add_special_tokens=False).ids


def byte_ids(texts, end):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {k: np.array([*lib.encode(t or "", add_special_tokens=False).ids, end], "<u4") for k, t in texts.items()}


def test_packing(odd, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for texts, d in both(odd, docs):
        ids = byte_ids(texts, 1)
        rows = packing.pack(d, path).collect()
        seqs, at = {}, dict.fromkeys(ids, 0)
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            x = ids[r.doc_id]
            assert r.start == at[r.doc_id] and r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length])
            at[r.doc_id] += r.length
            seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == {k: len(x) for k, x in ids.items()}
        ends = []
        for s in range(len(seqs)):
            end = 0
            for off, n in sorted(seqs[s]):
                assert off == end
                end += n
            ends.append(end)
        assert all(e == 2048 for e in ends[:-1])
    assert packing.pack(nothing, path).count() == 0


def test_bit_planes(odd, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for texts, d in both(odd, docs):
        for planes in ("byte", "bit"):
            got = {r.doc_id: r for r in bitplane.round_trip(d, path, planes=planes).collect()}
            at = 0
            for k, x in sorted(byte_ids(texts, 0).items()):
                assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(x), zlib.crc32(x))
                at += len(x)
    assert bitplane.round_trip(nothing, path).count() == 0
    for n in (0, 1, 7, 65536, 65537):
        x = np.random.default_rng(n).integers(0, 1 << 32, n).astype("<u4")
        for planes in ("byte", "bit"):
            payload, index = bitplane.shuffle(x, 4, planes)
            assert (bitplane.unshuffle(payload, index, n, 4, planes) == x).all()


def test_neighbours(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in e.collect()]
    rows += [(10_000 + i, rows[20][1]) for i in range(40)] + [(20_000, None), (20_020, [0.0] * 64), (20_040, [float("nan")] * 64), (20_060, [1.0, None] * 32), (None, rows[0][1])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.op5(d).collect():
        got.setdefault(r.query_id, []).append(r)
    good = {i: np.array(v) for i, v in rows if i is not None and i < 20_000}
    ids, m = np.array(list(good)), np.stack(list(good.values()))
    hits = total = 0
    for q in [i for i in good if i % 20 == 0]:
        s = m @ good[q]
        o = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:20]
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in [r.vec_id for r in mine]
        assert all(abs(r.score - good[q] @ good[r.vec_id]) < 1e-12 for r in mine)
        hits += len({int(ids[j]) for j in o} & {r.vec_id for r in mine})
        total += 20
    assert hits / total >= 0.9 and set(got) == {i for i in good if i % 20 == 0}
    few = spark.createDataFrame(rows[:3], d.schema)
    assert ann.op5(few).count() == 2
    assert ann.op5(d.limit(0)).count() == 0


def test_sharding(docs, nothing):
    names = tuple(f"n{i}" for i in range(10))
    t = sharding.table(names, 1009)
    counts = np.bincount(t)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(t, fewer, strict=True) if a != 9)
    assert moved < 0.3 * 1009
    for r in sharding.placed(docs.withColumn("slot", F.lit("clash"))).collect():
        s = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r.slot == s and r.shard == f"shard-{sharding.table(tuple(f'shard-{i:04d}' for i in range(64)))[s]:04d}"
    assert sharding.op9(nothing).count() == 0
    with pytest.raises(ValueError):
        sharding.table(names, 1000)


def brute_labels(w, templates, containment):
    """Labels of templates that some window of words meets, and the highest containment."""
    found, best = set(), 0.0
    for label, (tw, need, length) in licenses.measures(templates, containment).items():
        at = [i for i, x in enumerate(w) if x in tw]
        most = max((len({w[j] for j in at if i <= j < i + length}) for i in at), default=0)
        if most >= need:
            found.add(label)
            best = max(best, most / len(tw))
    return found, best


def test_licenses(spark, odd, docs, nothing):
    letter = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    notices = []
    for text in licenses.TEMPLATES.values():
        w = text.split(" ")
        notices += [text, "\n * ".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6)), " ".join(w[: len(w) * 3 // 4]), " filler ".join(w), "x " * 700 + text + " y" * 600]
    notices += ["cc by " * 700, "all rights " + "reserved " * 3, None, "", "Ⅿit İ licensed K"]
    more = spark.createDataFrame([(100 + i // 2 if i % 7 else None, t, "en", "s", 1, "k", 1, 2) for i, t in enumerate(notices)], DOCS)
    for d in (odd.union(more), docs):
        exp = []
        for r in d.select("doc_id", "text").collect():
            w = letter.findall((r.text or "").translate(AZ))
            hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            found, best = brute_labels(w, licenses.TEMPLATES, licenses.CONTAINMENT)
            base = {label for _, label in hits}
            exp.append((str(r.doc_id), len(w), len(hits), min([i for i, _ in hits], default=-1), max([i for i, _ in hits], default=-1), ",".join(sorted(base)), ",".join(sorted(base | found)), round(1.0 if hits else best, 9)))
        got = [(str(r.doc_id), r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.op10(d).collect()]
        assert sorted(got) == sorted(exp)
    wrapped = [t for t in licenses.op10(more).select("labels").collect() if "mit-text" in t.labels]
    assert len(wrapped) >= 3
    assert licenses.op10(nothing).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(odd, templates={"none": "..."})


def test_quality_model(spark, docs, odd, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_lm.classify(docs, labels).join(labels, "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1 and not r.toxic]
    junk = [r.kept for r in got if r.quality == 0]
    assert sum(clean) == len(clean) and sum(junk) <= 0.5 * len(junk)
    assert quality_lm.classify(odd, labels.limit(0)).count() == odd.count()
    assert quality_lm.classify(nothing, labels).count() == 0


def test_quality_verdict_catches_toxic_and_junk(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_lm.op2(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    clean = [r.kept for r in got if r.quality == 1 and not r.toxic]
    toxic = [r.kept for r in got if r.quality == 1 and r.toxic]
    junk = [r.kept for r in got if r.quality == 0]
    assert len(clean) - sum(clean) <= 0.01 * len(clean)
    assert len(toxic) - sum(toxic) >= 0.6 * len(toxic)
    assert len(junk) - sum(junk) >= 0.9 * len(junk)


def brute_perplexities(rows, trusted, held):
    """Modified Kneser-Ney over bytes in plain dictionaries: {key: (n_bytes, bits)} of rows (key, text)."""
    n = quality_lm.ORDER
    grams = lambda t: [(b"\0" * (n - 1) + t)[i : i + n] for i in range(len(t))]
    raw = [(k, (t or "").encode()) for k, t in rows]
    counts = {n: Counter(g for k, t in raw if k in trusted and not held(t) for g in grams(t))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, total, weight = {}, {}, {}
    for k, c in counts.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        d = [0.5, 1.0, 1.5] if min(of[1], of[2], of[3]) == 0 else [min(float(i), max(0.05, i - (i + 1) * y * of[i + 1] / of[i])) for i in (1, 2, 3)]
        cut[k] = lambda m, d=d: d[min(m, 3) - 1]
        total[k], weight[k] = Counter(), Counter()
        for g, m in c.items():
            total[k][g[:-1]] += m
            weight[k][g[:-1]] += cut[k](m)

    @functools.cache
    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        if not total[k][g[:-1]]:
            return p(g[1:])
        m = counts[k][g]
        return ((m - cut[k](m) if m else 0) + weight[k][g[:-1]] * p(g[1:])) / total[k][g[:-1]]

    return [(k, len(t), -sum(math.log2(p(g)) for g in grams(t))) for k, t in raw]


def held_out(t):
    return bool(quality_lm._held(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def test_quality_model_equals_brute_force(spark, odd, docs):
    """Perplexities and limits, with repeated and null keys, a null language, a long text, and labels of nobody."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    some = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(999, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int")
    again = [(6, "another text of one key", "en", "s", 1, "k", 1, 2), (None, "no key " * 9, None, "s", 1, "k", 1, 2), (None, "no key " * 9, "fr", "s", 1, "k", 1, 2), (70, "long text " * 60_000, "en", "s", 1, "k", 1, 2)]
    for d, l in ((docs, labels), (odd.union(spark.createDataFrame(again, DOCS)), some), (odd, labels.limit(0))):
        rows = [(r.doc_id, r.text, r.lang) for r in d.collect()]
        trusted = {r.doc_id for r in l.collect() if r.quality == 1 and not r.toxic}
        one = [(i, t) for i, (_, t, _) in enumerate(rows)]
        good = {i for i, (k, _, _) in enumerate(rows) if k in trusted} or {i for i, _ in one}
        every = not trusted
        want = brute_perplexities(one, good, (lambda t: False) if every else held_out)
        use = [(rows[i][2], n, bits) for i, n, bits in want if i in good and n and (every or held_out((rows[i][1] or "").encode()))]
        lim = {}
        for lang in {x[2] for x in rows}:
            mine = [x for x in use if x[0] == lang] if lang else []
            mine = mine or use
            rate = sum(x[2] for x in mine) / sum(x[1] for x in mine) if mine else None
            mixed = sorted((x[2] + quality_lm.PRIOR * rate) / (x[1] + quality_lm.PRIOR) for x in mine)
            lim[lang] = (rate, mixed[math.ceil(len(mixed) * quality_lm.QUANTILE - 1e-9) - 1]) if mine else None
        got = sorted((str(r.doc_id), str(r.lang), r.n_bytes, r.perplexity or 0, r.judged or 0, r.limit, r.kept) for r in quality_lm.classify(d, l).collect())
        exp = []
        for i, n, bits in want:
            k, _, lang = rows[i]
            rate, most = lim[lang]
            exp.append((str(k), str(lang), n, 2 ** (bits / n) if n else 0, 2 ** ((bits + quality_lm.PRIOR * rate) / (n + quality_lm.PRIOR)) if n else 0, most))
        assert len(got) == len(exp)
        for g, e in zip(got, sorted(exp), strict=True):
            assert g[:3] == e[:3] and g[3:5] == pytest.approx(e[3:5], rel=1e-5)
            assert 0 <= math.log2(g[5]) - e[5] <= 1.01 / quality_lm._BINS
            assert g[6] == (not e[2] or g[4] <= g[5])


def test_quality_screen_keeps_rows_by_their_own_text(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    key = next(r.doc_id for r in quality_lm.classify(docs, labels).where("kept").orderBy("doc_id").collect() if labels.where(f"doc_id = {r.doc_id}").isEmpty())
    bad = "".join(chr(33 + (i * i * 7919) % 90) for i in range(3000))
    d = docs.union(spark.createDataFrame([(key, bad, "en", "s", 1), (None, bad, "en", "s", 1), (None, "", "en", "s", 1)], docs.schema))
    out = quality_lm.screened(d, labels)
    assert out.dtypes == d.dtypes
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert (key, bad) not in kept and (None, bad) not in kept and (None, "") in kept and any(k == key for k, _ in kept)


def test_model_is_a_distribution(spark):
    d = spark.createDataFrame([("en", 1, "the cat sat. the dog sat!"), ("en", 2, "A dog ate the cat")], "lang string, id bigint, text string")
    rows = {r.key: r for r in quality_lm.model(quality_lm.gram_counts(quality_lm.chunks(d), every=True)).collect()}
    keys = np.array(sorted(rows), np.int64)
    for ctx in (b"\0\0\0\0", b"the ", b" dog", b"zzzz", b"a\0\0t"):
        grams = (np.int64(int.from_bytes(ctx, "big")) << 8) | np.arange(256)
        need = quality_lm._keys(grams)
        p = np.array([getattr(rows.get(int(k)), "p", None) or 0.0 for k in need])
        w = np.array([getattr(rows.get(int(k)), "weight", None) or 1.0 for k in need])
        assert keys.size and np.exp2(quality_lm._log2p(grams, need, p, w)).sum() == pytest.approx(1, abs=1e-9)


def test_kernels():
    data = np.frombuffer(b" ab  c\nd", np.uint8)
    s, e, b = kernels.spans(data, np.array([0, 3, 3, 8]))
    assert [bytes(data[x:y]) for x, y in zip(s, e, strict=True)] == [b"ab", b"c", b"d"] and b.tolist() == [0, 1, 1, 3]


def test_repeated_and_null_keys(hard):
    """Rows of one key, or of none, are rows of their own; other columns do no harm."""
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text or "") for r in hard.collect()]
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    sha = lambda ids: hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert sorted((str(r.doc_id), r.ids_sha256) for r in bpe.coded(hard, path).collect()) == sorted((str(k), sha(lib.encode(t, add_special_tokens=False).ids)) for k, t in rows)
    led = ledger.op3(hard).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars) for r in led) == sorted((str(k), len(words(t)), sum(map(len, words(t)))) for k, t in rows)
    kept = ledger.screened(hard)
    assert kept.dtypes == hard.dtypes and kept.count() == sum(r.kept for r in led)
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    ids = [(k, lib.encode(t, add_special_tokens=False).ids) for k, t in rows]
    pieces = packing.pack(hard, path).collect()
    total = Counter()
    for k, x in ids:
        total[k] += len(x) + 1
    mine, seqs = Counter(), {}
    for r in pieces:
        mine[r.doc_id] += r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert mine == total
    for s, parts in seqs.items():
        end = 0
        for off, n in sorted(parts):
            assert off == end
            end += n
        assert end == 2048 or s == max(seqs)
    planes = bitplane.round_trip(hard, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in planes) == sorted((str(k), len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4"))) for k, x in ids)
    end = 0
    for r in sorted(planes, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens
    placed = sharding.op9(hard).collect()
    assert len(placed) == len(rows) and len({r.shard for r in placed if r.doc_id is None}) == 1


def recalls(rows, got, k=20):
    """The recall of each query, by true scores: a neighbour as near as the k-th counts."""
    ids, m = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r.score)
    out = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = np.delete(m @ m[q], q)
        kth = np.sort(s)[-k]
        out.append(sum(x >= kth - 1e-9 for x in found.get(int(ids[q]), [])) / k)
    return np.array(out)


@pytest.mark.parametrize("shape", ["clusters", "lognormal"])
def test_neighbours_in_awkward_tables(spark, shape):
    """Tight clusters, and norms of very unlike sizes: nine in ten neighbours are found on average, and few queries find little."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    x = x + 9 * rng.normal(size=(60, 32))[rng.integers(60, size=6000)] if shape == "clusters" else x * np.exp(rng.normal(size=(6000, 1)))
    rows = [(i, v) for i, v in enumerate(x)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>").repartition(4)
    each = recalls(rows, ann.op5(d).collect())
    assert each.mean() >= 0.9 and (each < 0.5).mean() <= 0.02


def test_neighbours_of_repeated_keys(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (None, [9.0, 9.0]), (3, [1.0, 2.0, 3.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("list", F.lit(1)).withColumn("q", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.op5(d).orderBy("rank").collect()]
    assert got == [(20, 1, 2, 3.0), (20, 2, 1, 1.0)]


def test_pipeline(spark, hard):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_dedup", "substring_dedup", "packing"]
    for start in (docs, docs.union(hard.select(docs.columns).where("octet_length(coalesce(text, '')) < 1000000"))):
        kept = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = [(r.doc_id, r.text, r.n_chars) for r in kept.collect()]
            out = stage(spark, kept, SF)
            assert out.dtypes == docs.dtypes
            after = out.collect()
            now = Counter((r.doc_id, r.text) for r in after)
            if name == "quality_classifier":
                assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in quality_lm.classify(kept, labels).where("kept").collect())
                assert not now - Counter((k, t) for k, t, _ in before)
            elif name == "quality_rules":
                led = ledger.ledger(spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(before)], "doc_id bigint, text string"))
                assert now == Counter(before[r.doc_id][:2] for r in led.where(~ledger.rejected(2)).collect())
            elif name == "near_dedup":
                _, comp = brute_components(dict(enumerate(t for _, t, _ in before)), 5, 80)
                least = [min((before[i][0] for i in comp if comp[i] == c and before[i][0] is not None), default=None) for c in set(comp.values())]
                assert Counter(r.doc_id for r in after) == Counter(least) and not now - Counter((k, t) for k, t, _ in before)
            else:
                want = brute_cuts([(k, t) for k, t, _ in before])
                loses = {(k, n, m) for k, n, m, _ in want if m}
                assert sorted((str(r.doc_id), " ".join(words(r.text))) for r in after) == sorted((str(k), t) for k, _, _, t in want)
                assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in after) and loses
            kept = spark.createDataFrame(after, docs.schema)
        rows = [(r.doc_id, r.text) for r in kept.collect()]
        ids = byte_ids(dict(enumerate(t for _, t in rows)), 1)
        total = Counter()
        for i, (k, _) in enumerate(rows):
            total[k] += len(ids[i])
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
        assert {r.doc_id: r.n for r in packed} == dict(total)
