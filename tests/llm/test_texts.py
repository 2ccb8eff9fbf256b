"""Operators on documents against brute force, with the odd cases of every contract."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from pagetrawl.llm import common, decontaminate, near_dedup, packing, pii, queries, suffix_dedup, token_files
from pagetrawl.llm.common import TextEncoder

SF = "/root/testdata/sf0.001"
LINE = "the one line that is found in very many of the documents here and there and everywhere"
ODD = ["a  b", "\n\n x", "x \n y", "don't ,.", " a", " ", "\t", "a\tb  \n", "ΑΣ ΣΑ. É́ x", "a\x85b\xa0c  d", "x.\n", "\n \n", "a\n b\n", "a.\nB", "1,", "x\r\ny z", "\x1cq <|endoftext|> z", "straße!!! ***"]


def words(draw, n):
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts: nulls, empty and long texts, copies, near copies, a common line, marks, equal texts."""
    draw, found = random.Random(3), []
    base = words(draw, 120)
    for k in range(30):
        one = base.split()
        for _ in range(k % 7):
            one[draw.randrange(len(one))] = words(draw, 1)
        found.append(" ".join(one))
    found += [f"{LINE} {words(draw, draw.randint(0, 12))}" for _ in range(80)]
    found += [base, base, None, "", "two words", "two words", "TWO words", "\n\n", words(draw, 6000), "é" * 300, "ab" * 400, *ODD]
    return list(enumerate(found))


@pytest.fixture(scope="module")
def docs(spark, texts):
    """The texts with other columns, among them names that the operators use inside, and a repeated row."""
    rows = [(i, t, "x", 1, "k", None) for i, t in [*texts, texts[5]]]
    return spark.createDataFrame(rows, "doc_id long, text string, component string, h int, key string, bands string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- ids


@pytest.mark.parametrize("name,keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_give_the_ids_of_the_whole(texts, name, keeps):
    encode, whole = TextEncoder(path(name), keeps, limit=50), Tokenizer.from_file(path(name))
    for text in [t or "" for _, t in texts] + [a + b for a in ODD for b in ODD]:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert encode(text) == np.array(ids, "<u4").tobytes(), text


@pytest.mark.parametrize("bits", [False, True])
def test_planes_give_the_ids_back(bits, tmp_path):
    draw = np.random.default_rng(1)
    written = [(k if k % 3 else None, draw.integers(0, 2**32, n).astype("<u4")) for k, n in enumerate([0, 1, 700, 64, 128, 5])]
    with open(tmp_path / "f", "wb") as sink:
        writer = token_files.PlaneWriter(sink, block=64, bits=bits)
        for doc_id, ids in written:
            writer.add(doc_id, ids.tobytes())
        assert writer.close() == sink.tell()
    with open(tmp_path / "f", "rb") as source:
        found = list(token_files.read_file(source))
    assert [d for d, _ in found] == [d for d, _ in written]
    assert all((a == b).all() for (_, a), (_, b) in zip(found, written))


def test_token_files(docs, texts, empty):
    name = path("word_bpe_49k.json")
    found = sorted(token_files.token_files(docs, name, block=64, file_ids=500).drop("file").collect(), key=lambda r: r["start"])
    whole, at, expected = Tokenizer.from_file(name), 0, []
    for doc_id, text in sorted([*texts, texts[5]], key=lambda r: r[0]):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in found] == expected
    assert token_files.token_files(empty, name).count() == 0


def test_packing(docs, texts, empty):
    name = path("byte_bpe_50k.json")
    rows = packing.pack(docs, name, pool_ids=3000).collect()
    whole, pieces, sequences = Tokenizer.from_file(name), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == {i for i, _ in texts}
    for doc_id, text in texts:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        copies = 2 if doc_id == texts[5][0] else 1
        got = Counter((r["start"], bytes(r["ids"])) for r in pieces[doc_id])
        assert sum(len(k[1]) // 4 * n for k, n in got.items()) == copies * len(ids)
        assert all(b == ids[s : s + len(b) // 4].tobytes() for s, b in got)
        assert all(r["doc_tokens"] == len(ids) and r["length"] == len(r["ids"]) // 4 for r in pieces[doc_id])
    padding = total = 0
    groups = defaultdict(int)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1]] and ends[-1] <= own[0]["tier"]
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else 1024 - ends[-1]
        total += ends[-1]
        groups[own[0]["step_group"]] += own[0]["tier"]
    assert padding <= 0.05 * total and max(groups.values()) <= 8192
    assert packing.pack(empty, name).count() == 0


# --- personal data


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum((x - 9 if x > 9 else x) for x in (int(c) * (1 + i % 2) for i, c in enumerate(d[::-1]))) % 10 == 0


def base_spans(text):
    number = lambda m: re.sub(r"\D", "", m)
    valid = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 12 <= len(number(m)) <= 19 and luhn(number(m)), "phone": lambda m: 9 <= len(number(m)) <= 15,
    }
    found = [(m.start(), k, n, m.end()) for k, (n, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid[n](m.group())]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found))


PRIVATE = [
    "x@y.co.uk%z@a.b", "a@b @c.d e.f@-.g", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.02.3", "é 4111 1111-1111 1111 and 4111111111111112",
    "+1 (444) 555-3382, +49 30 1234567890123456", "+1 4111111111111111", "5 4111111111111111", "9" * 30000, "a" * 30000 + "@b.c", "1." * 20000,
    "account DE89 3704 0044 0532 0130 00 or DE88370400440532013000", "token = \"" + "0af3" * 10 + "\" and " + "b2" * 20,
]


def test_pii(spark, docs, texts, empty):
    rows = [(k, t) for k, t in enumerate(PRIVATE)] + [(100 + i, t) for i, t in texts]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, __email string")
    found = pii.pii_spans(frame)
    base = pii.joined(pii.F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))).alias("base")
    got = by_id(found.select("doc_id", "__email", base, pii.joined(pii.F.col("pii")).alias("spans"), pii.masked(pii.F.col("text"), pii.F.col("pii")).alias("m")))
    for doc_id, text in rows:
        assert got[doc_id]["base"] == base_spans(text or ""), text[:80]
    assert got[10]["spans"] == "iban:8:35" and got[11]["spans"] == "key:9:49"
    assert got[10]["m"] == "account <IBAN> or DE88370400440532013000"
    assert got[0]["__email"] == "e" and pii.pii_spans(empty).count() == 0


def test_ibans_before_other_words(spark):
    compact, grouped, other = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    after = ["", " Please", " OR", " 5", " A friend", ".", " please", " 12345 67", " NO ID 4711 HERE AND THERE"]
    cases = [(f"é {x}{y}", [x]) for x in (compact, grouped, other, "NO9386011117947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S") for y in after]
    cases += [(f"{grouped} {other} {compact} X", [grouped, other, compact]), (compact + "x", []), (compact + "9 OK", []), ("DE88 3704 0044 0532 0130 00 OR", [])]
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = by_id(pii.pii_spans(frame, tuple(k for k in pii.KINDS if k.name == "iban")))
    for k, (text, expected) in enumerate(cases):
        assert [text[s["start"] : s["end"]] for s in got[k]["pii"]] == expected, text


def test_pii_is_native(spark):
    plan = queries.op1_pii(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# --- near-duplicates


def shingles(text):
    w = near_dedup.words_of(text or "")
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(spark, docs, texts, empty, monkeypatch):
    monkeypatch.setattr(near_dedup, "FEW", 2)  # so that a small table takes every way
    monkeypatch.setattr(near_dedup, "SPARE_BANDS", 1)
    sets, parent = {i: shingles(t) for i, t in texts}, {i: i for i, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), root(i), root(i) == i)
    assert near_dedup.near_duplicates(empty).count() == 0
    loose = near_dedup.near_duplicates(spark.createDataFrame([(None, LINE), (None, LINE), (4, None)], "doc_id long, text string")).collect()
    assert sorted((str(r["component_id"]), r["kept"]) for r in loose) == [("4", True), ("None", True), ("None", True)]


def test_pairs_of_one_large_undecided_bucket(spark):
    draw = random.Random(9)
    texts = [f"{LINE} {words(draw, 40)}" for _ in range(40)]
    texts += [f"{texts[7]} {words(draw, 3)}"]
    n = [len(shingles(t)) for t in texts]
    banded = spark.createDataFrame([(k, n[k], 5, n[k]) for k in range(41)], "doc_id long, n long, key long, tail long")
    # no band but the one of the common line is shared
    candidates = spark.createDataFrame([(k, t, [5, 100 + k]) for k, t in enumerate(texts)], "doc_id long, text string, bands array<long>")
    found = near_dedup.near_links(banded, candidates)
    assert found is not None and {(r["id"], r["component"]) for r in found.collect()} == {(7, 7), (40, 7)}


def test_one_band_is_enough(spark):
    text = words(random.Random(10), 60)
    texts = spark.createDataFrame([(1, text, [1, 2, 3]), (2, f"{text} more", [1, 5, 6])], "doc_id long, text string, bands array<long>")
    pairs = spark.createDataFrame([(2, 1)], "a long, b long")
    assert [tuple(r) for r in near_dedup.confirmed(pairs, texts).collect()] == [(2, 1)]


def test_signatures_are_permuted_ranks():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**63, 900).astype(np.uint64) for _ in range(2))
    one, two = np.unique(a), np.unique(np.concatenate([a[:720], b[:180]]))
    s = near_dedup.signatures([one, two, one[:1], np.empty(0, np.uint64)])
    assert abs((s[0] == s[1]).mean() - 720 / 1080) < 0.12
    assert sorted(s[2] >> 24) == list(range(near_dedup.SLOTS)) and (s[3] == 0xFFFFFFFF).all()
    assert (near_dedup.signatures([one])[0] == s[0]).all()


# --- repeated passages


def kept(texts):
    seen, found = {}, {}
    for doc_id, text in texts:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if seen.setdefault(raw[s : s + 100], (doc_id, s)) != (doc_id, s):
                gone[s : s + 100] = b"\1" * 100
        runs = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        rest = bytes(c for c, g in zip(raw, gone) if not g)
        found[doc_id] = (len(raw), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return found


@pytest.mark.parametrize("collection,rows", [(1 << 12, 10000), (4, 7)])
def test_suffix_dedup(spark, docs, texts, empty, monkeypatch, collection, rows):
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    monkeypatch.setattr(suffix_dedup, "LARGEST", collection)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = suffix_dedup.without_repeats(docs).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    expected = kept(texts)
    assert len(found) == len(texts) + 1
    for r in found:
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert (r["n_bytes"], removed, len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) == expected[r["doc_id"]]
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_construction_sorts_all_suffixes():
    draw = random.Random(4)
    texts = [bytes(draw.choices(b"ab", k=draw.randint(1, 40))) for _ in range(30)]
    bwt, lcp, rows = suffix_dedup.construct(texts)
    ranked = sorted((t[k:], i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
    shared = [0] + [next((n for n in range(min(len(x), len(y)) + 1) if x[: n + 1] != y[: n + 1]), len(x)) for (x, *_), (y, *_) in zip(ranked, ranked[1:])]
    assert sorted(lcp.tolist()) == sorted(min(len(a), s) for s, (a, *_) in zip(shared, ranked)) and len(bwt) == len(ranked)
    order = np.argsort(bwt, kind="stable")
    for i, t in enumerate(texts):
        at = rows[i]
        for k in range(len(t)):
            assert ranked[at][0] == t[k:]
            at = order[at]


# --- benchmark items


def test_leaks(spark, docs, texts, empty):
    draw = random.Random(5)
    items = [(k, words(draw, 25)) for k in range(40)] + [(40, None), (41, ""), (42, "tiny item")]

    def edited(text, share):
        out = bytearray(text.encode())
        for _ in range(int(share * len(out))):
            at, kind = draw.randrange(len(out)), draw.random()
            if kind < 0.34:
                out[at : at + 1] = b"z"
            elif kind < 0.67:
                out[at:at] = b"y"
            else:
                del out[at]
        return out.decode()

    own = [(k, f"{words(draw, 60)} {edited(t, 0.04 * (k % 2)).upper() if k % 3 else t} {words(draw, 60)}") for k, t in items[:40]]
    clean = [(100 + i, t) for i, t in texts]
    frame = spark.createDataFrame([*own, (90, "a Tiny, item."), *clean], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(frame, bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [*((k, k) for k in range(40)), (90, 42)]
    assert {r["doc_id"] for r in decontaminate.without_leaks(frame, bench).collect()} == {i for i, _ in clean}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(frame, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [14, 20, 40, 80, 113, 200])
def test_short_items_with_all_edits_are_found(size):
    draw = random.Random(size)
    rows = [(k, words(draw, size)[:size].strip().ljust(size, "x")) for k in range(150)]
    items, texts = decontaminate.Items(rows), []
    for _, item in rows:
        out = bytearray(item.encode())
        for _ in range(int(decontaminate.MOST_EDITS * size)):
            at, kind = draw.randrange(len(out)), draw.randrange(3)
            out[at : at + (kind != 1)] = (b"z", b"y", b"")[kind]
        texts.append(f"{words(draw, 30)} {out.decode()} {words(draw, 30)}".encode())
    found = {(t, i): d for t, i, _, _, d in decontaminate.find(items, texts)}
    # against brute force
    for t, text in enumerate(texts):
        for i in range(t, min(t + 3, len(texts))):
            best = items.distance(i, text)[0]
            assert found.get((t, i)) == (best if best <= int(decontaminate.MOST_EDITS * size) else None)


def test_edit_distance():
    draw = random.Random(6)
    for _ in range(60):
        item, text = words(draw, 3).encode(), words(draw, 8).encode()
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item):
            new = [i + 1]
            for j, d in enumerate(text):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        items = decontaminate.Items([(1, item.decode())])
        assert items.distance(0, text)[0] == min(min(row), len(item))


def test_helpers():
    assert common.numbered([["a", "b"], ["a"]]) == (["a", "b"], [0, 1, 0])


def test_construction_sorts_the_new_rows_only(monkeypatch):
    draw = random.Random(5)
    base = words(draw, 200).encode()
    some = [base[a : a + draw.randint(100, 170)] for a in (draw.randrange(len(base) - 170) for _ in range(60))]
    sizes, sort = [], np.argsort

    def argsort(x, *args, **kwargs):
        sizes.append(len(x))
        return sort(x, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(np, "argsort", argsort)
        _, _, rows = suffix_dedup.construct(some)
    assert max(sizes) <= len(some)
    # the ends of whole texts stand in the order of their texts
    assert [some[k] for k in np.argsort(rows)] == sorted(some)
