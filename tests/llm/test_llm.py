import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratum.llm import bpe, classifier, exact_dedup, graph, packing, pii, quality_rules, simhash, suffix_dedup, token_counts, token_files
from stratum.llm.queries import ORACLE_SQL, QUERIES
from stratum.llm.tokens import LibraryEncoder, encoder

from ..compare import DATA, rows_match

ODD = ["", " ", "  a", "a  b", "a b ", "x<|endoftext|>y z", "a.b,c d.\ne f", "a\nb\nc\nd", "a,, b .c", "\x01a \x02b.", "1.2,3\n4", "word's. It'll,", "İstanbul ǅ ß.", "<|x.|> y", "tab\t x", "é ́x", "\x1c a \x1d b", "🙈 ok", "a" * 3000, "ab " * 400]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, same string, key string, t string, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use."""
    rows = [(i, t, "en", None, None, 1, "x", "y", "z", "w") for i, t in enumerate(ODD)]
    rows += [(None, None, None, None, None, None, None, None, None, None)] * 2 + [(900, "twice", "en", "s", 5, 1, "x", "y", "z", "w")] * 2 + [(901, "twice", "en", "s", 5, 1, "x", "y", "z", "w")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_matches_sql(spark, name):
    rows_match(spark, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("path", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_whole_texts(path):
    enc = LibraryEncoder(path)
    for texts in [ODD] + [[t] for t in ODD]:
        ids, n = enc.encode(pa.array(texts))
        want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_bpe(spark, odd, empty):
    lib, own = encoder("byte_bpe_50k.json").tokenizer, encoder("byte_bpe_50k.json", bpe.RankArrayBpe)
    for t in ODD:
        assert own.encode(pa.array([t]))[0].tolist() == lib.encode(t, add_special_tokens=False).ids
        assert own.scan(t.encode()) == own.heap(t.encode())
    rows = bpe.round_trip(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        t = ODD[r.doc_id] if r.doc_id is not None and r.doc_id < len(ODD) else "" if r.doc_id is None else "twice"
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(odd)).collect()}
    assert {(i, t) for i, t in enumerate(ODD)} <= back
    assert bpe.round_trip(empty).count() == 0


def test_token_counts(spark, odd, empty):
    lib = encoder("byte_bpe_50k.json").tokenizer
    n = [len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()]
    table = token_counts.limit_table(token_counts.histogram(odd))
    for r in table.collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_total, r.truncated_total) == (n.count(r.n_tokens), sum(x >= r.n_tokens for x in n), sum(n), sum(min(x, r.n_tokens) for x in n))
    assert {r.context_limit: r.truncated_total for r in token_counts.at_limits(table, [0, 7, 512, 99999]).collect()} == {x: sum(min(y, x) for y in n) for x in (0, 7, 512, 99999)}
    assert token_counts.limit_table(token_counts.histogram(empty)).count() == 0


def test_token_files(spark, odd, empty, tmp_path):
    lib = encoder("byte_bpe_50k.json").tokenizer
    token_files.write(odd, f"file://{tmp_path}/a")
    rows = sorted(token_files.read(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in rows[:2]] == [True, True] and [r.doc_id for r in rows[2:]] == sorted(r.doc_id for r in rows[2:])
    at = 0
    for r in rows:
        t = "" if r.doc_id is None else ODD[r.doc_id] if r.doc_id < len(ODD) else "twice"
        assert r.start == at and r.ids == lib.encode(t, add_special_tokens=False).ids + [2]
        at += r.n_tokens
    token_files.write(empty, f"file://{tmp_path}/b")
    assert token_files.read(spark, f"file://{tmp_path}/b").count() == 0


def test_more_ids_than_seventeen_bits():
    n = np.array([140_000, 3])
    ids = np.concatenate([np.random.default_rng(1).permutation(140_000), [5, 139_999, 0]]).astype(np.uint32)
    lengths = token_files.code_lengths(np.ones(140_000, np.int64))
    assert lengths.max() == 18
    codes, table, bits = token_files.canonical(lengths)
    payload, offsets, within = token_files.encode_docs(ids, n, codes, lengths)
    marks = within[token_files._every(n)] + np.repeat(offsets[:-1] * 8, -(-n // token_files.STRIDE))
    assert (token_files.decode_block(payload.tobytes(), marks, token_files._lanes(n), table, bits) == ids).all()
    with pytest.raises(ValueError, match="over 25"):
        token_files.code_lengths(np.ones((1 << 25) + 1, np.int64))


def test_parts_within_parts(spark, tmp_path, monkeypatch):
    """More parts than are sought at once; starts go on from part to part."""
    monkeypatch.setattr(token_files, "PART_IDS", 40)
    monkeypatch.setattr(token_files, "AT_ONCE", 4)
    docs = spark.createDataFrame([(i, "a b c d e f g") for i in range(300)] + [(None, "x")] * 3, "doc_id long, text string")
    token_files.write(docs, f"file://{tmp_path}/a")
    rows = sorted(token_files.read(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 3 + list(range(300)) and [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(303)]
    assert spark.read.parquet(f"file://{tmp_path}/a/blocks").select("part").distinct().count() > 30


def test_huffman():
    rng = np.random.default_rng(0)
    for size in (1, 2, 3, 300, 5000):
        counts = np.floor(rng.pareto(0.3, size)).clip(0, 10**12).astype(np.int64) + 1
        lengths = token_files.code_lengths(counts, 13)
        assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1 and lengths.max() <= 13
        codes, table, bits = token_files.canonical(lengths)
        n = np.array([0, 1, 700, 513, 512])
        ids = rng.integers(0, size, n.sum()).astype(np.uint32)
        payload, offsets, within = token_files.encode_docs(ids, n, codes, lengths)
        marks = within[token_files._every(n)] + np.repeat(offsets[:-1] * 8, -(-n // token_files.STRIDE))
        assert token_files.decode_block(payload.tobytes(), marks, token_files._lanes(n), table, bits).tolist() == ids.tolist()


def test_packing(spark, odd, empty):
    lib = encoder("word_bpe_49k.json").tokenizer
    rows = packing.pack(odd.filter("doc_id IS NOT NULL AND doc_id < 900").coalesce(1), window=64).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in enumerate(ODD):
        ids, at = np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)
    assert packing.pack(odd).filter("doc_id IS NULL").count() == 2 and packing.pack(empty).count() == 0
    assert packing.closest(10, {7: 1, 4: 2, 3: 1}, [7, 4, 3]) == {7: 1, 3: 1}


def test_packing_looks_at_all_lengths():
    """1600 + 1296 + 1200 fill the window; neither the 48 longest nor the 48 shortest lengths do."""
    lengths = [*range(1000, 1048), 1200, 1296, *range(1553, 1601)]
    packer = packing.Packer(4096)
    for n in lengths:
        packer.add(n, n)
    packer.pack(len(lengths) - 1)
    assert len(lengths) > packing.LENGTHS and sorted(n for _, _, n, seq, _ in packer.placed if seq == 0) == [1200, 1296, 1600]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, odd, empty):
    rng = np.random.default_rng(5)
    texts = ["a@b.c_d@e.f", "4111 1111 1111 1111", "++1 234 567 890", "0000255.1.1.01", "🙈 a@b.co +49 30 1234567", "a." * 5000 + "@b.c", "1.1.1.1" * 20] + ["".join(rng.choice(list("aB1234567890@.+- ()%_\nü🙈49"), rng.integers(1, 60))) for _ in range(1500)]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = personal(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert pii.report(odd).count() == odd.count() and pii.report(empty).count() == 0
    masked = pii.mask(spark.createDataFrame([(1, "mail a@b.co, ip 1.2.3.4!", 7), (2, None, 8)], "doc_id long, text string, extra long")).orderBy("doc_id").collect()
    assert [(r.text, r.extra) for r in masked] == [("mail [EMAIL], ip [IP]!", 7), (None, 8)]


def test_pii_many_matches_in_a_text(spark):
    """Text order and overlaps hold over blocks of matches, and masking cuts the text in the same places."""
    text = " ".join(f"a{i}@b.co (at 1[.]2[.]3[.]{i % 256}), 4111 1111 1111 1111 +49 30 {i:07d};" for i in range(700))
    df = spark.createDataFrame([(1, text), (2, "a@b.co and c@d.org" * 50)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in ((1, text), (2, "a@b.co and c@d.org" * 50)):
        want = personal(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(rows[i].spans.split(","))
        assert rows[i].n_spans == len(rows[i].spans.split(","))
        spans = sorted((int(s), int(e), k.upper()) for k, s, e in (x.split(":") for x in rows[i].spans.split(",")))
        out, at = "", 0
        for s, e, k in spans:
            if s >= at:
                out += t[at:s] + f"[{k}]"
            at = max(at, e)
        assert pii.mask(df).filter(F.col("doc_id") == i).first().text == out + t[at:]


def test_pii_traits_decide():
    """Spans with the same votes: what the corpus tells about a trait moves them apart."""
    kind, trait = 3, pii.VOTES + 5
    with_ = lambda votes, on: (kind, (*votes, *(1 if j == trait and on else 0 for j in range(pii.VOTES, pii.VOTES + len(pii.TRAITS)))))
    patterns = [(*with_((1, 1, 1, 1), False), 900), (*with_((0, 0, 0, 0), True), 900), (*with_((0, 1, 0, 1), True), 50), (*with_((0, 1, 0, 1), False), 50)]
    w = pii.train(patterns)[kind]
    odds = lambda v: w[0] + sum(a * b for a, b in zip(w[1:], v))
    assert odds(patterns[3][1]) > odds(patterns[2][1]) + 0.5 and odds(patterns[0][1]) > 2 and odds(patterns[1][1]) < -2


def test_pii_loose_cards_and_addresses(spark):
    """Cards and addresses that the strict patterns miss are candidates, and the classifier decides on them."""
    r = random.Random(7)

    def card():
        body = "4" + "".join(str(r.randrange(10)) for _ in range(14))
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(body))
        d = body + str(-total % 10)
        return [d[i : i + 4] for i in (0, 4, 8, 12)]

    plain = [f"my {('card', 'number')[i % 2]} {' '.join(card())} is lost" for i in range(40)] + [f"the server 81.{r.randrange(256)}.{r.randrange(256)}.9 is down" for _ in range(40)] + ["nothing of note"] * 40
    bad = ["years 2019 2020 2021 2022 2023", "std::vector and Abc::Def at 12:30:45", "ratio 1:2:3", "from 999[.]168[.]1[.]7", "pages 1234.5678.9012.3456", "order 10000000000000000000000000000000"]
    found = {"card 4111 1111 1111 1111 12/26.": "card:5:24", "visa 4111.1111.1111.1111": "card:5:24", "card 4111 1111 1111 1111 5500 0000 0000 0004": "card:5:24,card:25:44", "host 192[.]168[.]1[.]7 up": "ip:5:22", "server 2001:db8:85a3::8a2e:370:7334, up": "ip:7:35", "ip 2001:0db8:0:0:0:0:0:1": "ip:3:24"}
    texts = plain + bad + list(found)
    got = [x.spans for x in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()]
    of = lambda x: ",".join(y for y in x.split(",") if y.startswith(("ip", "card")))
    assert [of(x) for x in got[len(plain) + len(bad) :]] == list(found.values())
    assert not any(of(x) for x in got[len(plain) : len(plain) + len(bad)])
    masked = pii.mask(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).filter("text LIKE '%12/26.'").first().text
    assert masked == "card [CARD] 12/26."


def test_quality_rules(spark, odd, empty):
    rows = quality_rules.verdicts(odd)
    assert rows.count() == odd.count() and rows.filter("doc_id IS NULL AND n_words = 0 AND base_failed AND NOT kept").count() == 2
    assert quality_rules.verdicts(empty).count() == 0
    text = "a b c x a b c a b c\na b c\n\n a\na b c"
    r = quality_rules.verdicts(spark.createDataFrame([(1, text, "l", "s")], "doc_id long, text string, lang string, source string")).first()
    w = text.split()
    win = Counter(zip(w, w[1:], w[2:]))
    assert r.n_repeat_words == len({j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}) and r.n_dup_lines == 1


def test_quality_rules_have_no_largest_value(spark):
    """Texts of words of 200 characters have bounds of their own, and a blob of one word is beyond them."""
    docs = [(i, " ".join(f"{i}x{j}".ljust(190 + (7 * i + 3 * j) % 20, "w") for j in range(60)), "zh", "s") for i in range(40)]
    docs.append((40, " ".join(str(j) for j in range(59)) + " " + "w" * 200_000, "zh", "s"))
    rows = quality_rules.verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in rows if not r.kept} == {40} and not any(r.base_failed for r in rows)


def test_exact_dedup(spark, odd, empty):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    rows = exact_dedup.deduplicate(odd, index).collect()
    assert len(rows) == odd.count()
    for digest, own in {d: [r for r in rows if r.text_sha256 == d] for d in {r.text_sha256 for r in rows}}.items():
        assert sum(r.kept for r in own) == 1 and {r.group_size for r in own} == {len(own)} and {r.keep_id for r in own} == {max((r.doc_id for r in own if r.doc_id is not None), default=None)}
    # the same batch once more: all is known, and the copies count again
    again = exact_dedup.deduplicate(odd, index).collect()
    assert not any(r.kept for r in again) and {(r.text_sha256, r.keep_id, r.group_size) for r in again} == {(r.text_sha256, r.keep_id, 2 * r.group_size) for r in rows}
    assert index.rows().count() == len({r.text_sha256 for r in rows})
    halves = exact_dedup.deduplicate_halves(odd, exact_dedup.DigestIndex(spark, buckets=4)).collect()
    assert Counter(halves) == Counter(rows)
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len({r.text_sha256 for r in rows})
    assert exact_dedup.keep_first(empty).count() == 0 and exact_dedup.deduplicate(empty, exact_dedup.DigestIndex(spark)).count() == 0
    assert exact_dedup.deduplicate_halves(empty, exact_dedup.DigestIndex(spark)).count() == 0


def classes(n, links):
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    out = []
    for x in range(n):
        while root[x] != x:
            x = root[x]
        out.append(x)
    return out


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [tuple(map(int, x)) for x in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(120, 180)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = classes(181, links)
    assert got == {i: c for i, c in enumerate(want) if i != c}


@pytest.mark.parametrize("split", [5000, 20, 1])
def test_trie_links(spark, split):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]))
    want = classes(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 2])
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fp.view(np.int64))], "id long, fp long")
    got = {r.node: r.component for r in graph.components(simhash.links(df, split=split)).collect()}
    assert [got.get(i, i) for i in range(len(fp))] == want


def test_simhash(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        t = ODD[r.doc_id] if r.doc_id is not None and r.doc_id < len(ODD) else "" if r.doc_id is None else "twice"
        assert r.fp & (2**64 - 1) == simhash.fingerprint(t)
    assert {r.component_id for r in rows if r.doc_id is None} == {0}  # the empty texts' class
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    words = [f"w{i}" for i in range(400)]
    near = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:200] + ["x"] + words[201:])), (3, " ".join(f"v{i}" for i in range(400)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(near).collect()) == [1, 3]


def removed(rows, length, words):
    """Brute force: (id, bytes, removed, spans, kept, passages, words in them) of every row."""

    def repeated(texts, n):
        count = Counter(x[i : i + n] for x in texts for i in range(len(x) - n + 1))
        for x in texts:
            gone = {j for i in range(len(x) - n + 1) if count[x[i : i + n]] > 1 for j in range(i, i + n)}
            yield gone, sum(j - 1 not in gone for j in gone)

    raw = [(t or "").encode() for _, t in rows]
    out = Counter()
    for (d, _), b, (gone, n), (passage, m) in zip(rows, raw, repeated(raw, length), repeated([tuple(b.split()) for b in raw], words)):
        out[d, len(b), len(gone), n, bytes(c for i, c in enumerate(b) if i not in gone), m, len(passage)] += 1
    return out


@pytest.mark.parametrize("split", [5000, 4])
def test_similar_documents(spark, split):
    """Components of five-word similarity against all pairs, also where buckets are cut into parts."""
    r = random.Random(3)
    docs = []
    for _ in range(6):
        base = [f"w{r.randrange(10**6)}" for _ in range(300)]
        for _ in range(9):
            t = list(base)
            for at in r.sample(range(300), r.choice([0, 1, 2, 30])):
                t[at] = f"x{r.randrange(10**6)}"
            docs.append(" ".join(t))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, docs)]
    best = list(range(len(docs)))
    pairs = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(docs)) for j in range(i)]
    assert not any(0.76 < s < 0.8 for _, _, s in pairs)  # none within the estimate's error
    for _ in docs:
        for i, j, s in pairs:
            if s >= 0.8:
                best[i] = best[j] = min(best[i], best[j])
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(df, split=split).collect()}
    assert got == dict(enumerate(best)) and len(set(best)) < len(docs)


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("split", [5000, 4])
def test_equal_fingerprints_are_compared(spark, split, monkeypatch):
    """Different texts under one fingerprint (here: all of them) stay, and near copies among them are found."""
    true = simhash._signatures

    def equal(texts, words):
        fp, keys, sig = true(texts, words)
        return np.zeros_like(fp), keys, sig

    r = random.Random(4)
    body = lambda: [f"w{r.randrange(10**6)}" for _ in range(100)]
    tail = " ".join(["one line of nine words that comes many times"] * 50)
    shared = [" ".join(body()) + " " + tail for _ in range(12)]
    near = body()
    docs = shared + [" ".join(near), " ".join([*near[:50], "x", *near[51:]])]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert max(jaccard(a, b) for i, a in enumerate(shared) for b in shared[:i]) < 0.1 and jaccard(*docs[12:]) > 0.8
    assert sorted(x.doc_id for x in simhash.keep_one(df).collect()) == list(range(13))
    monkeypatch.setattr(simhash, "_signatures", equal)
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(df, split=split).collect()}
    assert got == {**{i: i for i in range(13)}, 13: 12}
    for key in (None, 7):  # groups that share a name
        named = spark.createDataFrame([(key, t) for t in docs], "doc_id long, text string")
        assert simhash.keep_one(named).count() == 13


def test_similar_documents_with_heavy_repeats(spark):
    """Groups against all pairs, where a much repeated line is in some copies only."""
    r = random.Random(5)
    line = "one line of nine words that comes many times".split()
    docs = []
    for n, times in [(300, 20), (300, 10), (100, 10), (100, 50)] * 3:
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        docs += [" ".join(base), " ".join(base + line * times)]
    pairs = [(i, j) for i, a in enumerate(docs) for j, b in enumerate(docs[:i]) if jaccard(a, b) >= 0.8]
    assert len(pairs) == 12
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(df).collect()}
    assert got == dict(enumerate(classes(len(docs), pairs)))


def test_trie_with_equal_fingerprints():
    rng = np.random.default_rng(6)
    fp = rng.choice(rng.integers(0, 1 << 10, 12, dtype=np.uint64), 60)
    bucket = np.sort(rng.integers(0, 3, 60))
    order = np.lexsort((fp, bucket))
    fp, bucket = fp[order], bucket[order]
    got = sorted(tuple(sorted(map(int, p))) for i, j in simhash.trie_pairs(bucket, fp, 3) for p in zip(i, j))
    assert got == [(i, j) for i in range(60) for j in range(i + 1, 60) if bucket[i] == bucket[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 3]


@pytest.mark.parametrize("hot", [3000, 3])
def test_suffix_dedup(spark, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    say = lambda n: " ".join(letters(int(k)) for k in rng.integers(1, 6, n))
    shared, passage = letters(450), say(70)
    rows = [(1, None), (2, ""), (3, "a" * 1000), (4, "ab" * 700), (5, "xyz" * 200), (5, "xyz" * 200), (None, "é" * 250 + "w")]
    rows += [(100 + i, letters(300) + shared[: 400 + i % 50] + letters(int(rng.integers(0, 900)))) for i in range(30)]
    # passages of 48 to 60 words, of which those of over 50 count, in texts of their own and across white space
    rows += [(200 + i, say(int(rng.integers(0, 80))) + " \n" + "\t ".join(passage.split()[i % 5 : 48 + i % 13]) + "  " + say(int(rng.integers(0, 80)))) for i in range(40)]
    rows += [(300, "one " * 51), (301, "two " * 52), (302, say(51)), (303, passage), (303, passage)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, seg string, id long")
    got = Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == removed(rows, 400, 51)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_transforms_merge():
    rng = np.random.default_rng(1)
    for _ in range(100):
        segs = [g for g in (rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 60), dtype=np.uint8) for _ in range(rng.integers(1, 8))) if len(g)]
        if segs:
            count = Counter(g[i : i + 8].tobytes() for g in segs for i in range(len(g) - 7))
            ends = np.cumsum([len(g) for g in segs])
            want = [int(e) - len(g) + i for g, e in zip(segs, ends) for i in range(len(g) - 7) if count[g[i : i + 8].tobytes()] > 1]
            assert suffix_dedup.repeated(np.concatenate(segs), ends, 8, 2, int(rng.integers(5, 100))).tolist() == want


def test_classifier(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odds, y = classifier.train(classifier.features(d).cache(), labels)["held_out"]
    assert ((odds >= 0) == (y == 1)).mean() >= 0.95
    kept = classifier.keep_good(d, labels)
    assert kept.columns == d.columns
    good = labels.filter("quality = 1")
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.99 * good.count()
    none = labels.filter("quality = 1")
    assert classifier.keep_good(odd, none).count() == odd.count() and classifier.keep_good(empty, labels).count() == 0
    few = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (3, 1), (4, 0), (None, 1), (5, None), (900, 1)], "doc_id long, quality int")
    assert classifier.keep_good(odd.unionByName(odd), few).columns == odd.columns


def test_classifier_against_brute_force(spark):
    """Features, scores and verdicts from the model's numbers, text by text; equal ids with different texts in any order."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    twice = d.limit(1).withColumn("text", F.lit("a different text under this id $$$"))
    rows = classifier.features(d.unionByName(twice)).cache()
    model = classifier.train(rows, labels)
    again = classifier.train(classifier.features(twice.unionByName(d)), labels)
    assert all(np.allclose(model[k], again[k]) for k in ("text", "meta", "mean", "scale", "limit"))
    got = sorted((r.doc_id, round(r.score, 6), r.kept) for r in classifier.score(rows, model).collect())
    buckets = {(r.lang, r.source): (r.a, r.b) for r in d.select("lang", "source", F.expr(f"int(pmod(xxhash64(coalesce(lang, '\\0')), {classifier.LANGS}))").alias("a"), F.expr(f"int(pmod(xxhash64(coalesce(source, '\\0')), {classifier.SOURCES}))").alias("b")).collect()}
    want = []
    for r in d.unionByName(twice).collect():
        t = r.text or ""
        words, count = t.split(), lambda chars, t=t: sum(t.count(c) for c in chars)
        chars, n = max(1, sum(map(len, words))), max(1, len(words))
        upper = sum(unicodedata.category(c) == "Lu" for c in t)
        again_ = sum(a == b for a, b in zip(words, words[1:]))
        x = [count("#*$%&|<>@^~_=\\{}[]") / chars, count("!?") / chars, upper / chars, count("0123456789") / chars, count(".,;:") / chars, chars / n, math.log1p(len(words)), len(set(words)) / n, again_ / n, t.count("\n") / chars]
        z = np.clip((np.array(x) - model["mean"]) / model["scale"], -8, 8)
        a, b = buckets[r.lang, r.source]
        m = model["meta"][a] + model["meta"][classifier.LANGS + b] + model["meta"][-2] * (math.log1p(r.n_chars or 0) - model["size"][0]) / model["size"][1] + model["meta"][-1]
        both = model["cal_text"][0] * (z @ model["text"][:-1] + model["text"][-1]) + model["cal_text"][1] + model["cal_meta"][0] * m + model["cal_meta"][1] - model["prior"]
        want.append((r.doc_id, round(1 / (1 + math.exp(-both)), 6), both >= model["limit"]))
    assert [g[::2] for g in got] == [w[::2] for w in sorted(want)] and np.allclose([g[1] for g in got], [w[1] for w in sorted(want)], atol=1e-5)


def test_one_odd_label_does_not_set_the_limit(spark):
    """A junk text labelled good, among fewer than 200 good ones, is rejected like the others of its kind."""
    good = [(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(80)) + ".") for i in range(60)]
    bad = [(100 + i, " ".join(f"###w{(i + j) % 9}$$$" for j in range(80))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in good + bad], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 1 if i == 100 else 0) for i, _ in bad[:40]], "doc_id long, quality int")
    assert {r.doc_id for r in classifier.keep_good(docs, labels).collect()} == set(range(60))


def test_pipeline(spark):
    """Every stage against a plain version of it on what the stage before kept."""
    names = spark.read.parquet(f"{DATA}/documents.parquet").columns
    docs, held = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), "stage")
        assert docs.columns == names
        held.append({r.doc_id: r for r in docs.collect()})
    good, once, apart, masked = held
    verdicts = {r.doc_id for r in QUERIES["op8_quality_classifier"](spark, DATA).filter("kept").collect()}
    assert set(good) == verdicts
    last = {}
    for i in sorted(good):
        last[good[i].text or ""] = i
    assert set(once) == set(last.values())
    texts = {i: (r.text or "").encode().lower().split() for i, r in once.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in texts.items()}
    ids = sorted(sets)
    near = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for k, i in enumerate(ids) for j in ids[:k] if sets[i] & sets[j]]
    sure, never = (classes(len(ids), [(ids.index(i), ids.index(j)) for i, j, s in near if s >= t]) for t in (0.84, 0.76))
    assert {ids[x] for x in set(never)} <= set(apart) <= {ids[x] for x in set(sure)}  # between the two the estimate decides
    for r in pii.report(spark.createDataFrame([(i, r.text) for i, r in apart.items()], "doc_id long, text string")).collect():
        t, out, at = apart[r.doc_id].text or "", "", 0
        for start, end, kind in sorted((int(x.split(":")[1]), int(x.split(":")[2]), x.split(":")[0].upper()) for x in r.spans.split(",") if x):
            if start >= at:
                out += t[at:start] + f"[{kind}]"
            at = max(at, end)
        out += t[at:]
        assert (masked[r.doc_id].text or "") == out and masked[r.doc_id].n_chars == len(out)
    lib = encoder("word_bpe_49k.json").tokenizer
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(masked)
    for i, rs in pieces.items():
        tokens, at = np.array(lib.encode(masked[i].text or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(tokens[at : at + r.length].tobytes())
            at += r.length
        assert at == len(tokens)
    assert not any(re.search(r"[a-z]@[a-z0-9]+\.", r.text or "") for r in masked.values())


def test_pipeline_of_odd_rows(spark, odd, empty, tmp_path):
    """Nulls, repeated rows, long texts and columns whose names the operators use; and a table without rows."""
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0), (3, 0, 1), (None, 1, 0), (900, None, None)], "doc_id long, quality int, toxic int")
    for name, rows in (("odd", odd), ("empty", empty)):
        rows.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, f"file://{tmp_path}/{name}"), "stage")
            assert docs.columns == odd.columns
        found = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert {r.doc_id for r in found} == {r.doc_id for r in docs.collect()} and bool(found) == (name == "odd")
