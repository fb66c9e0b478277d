"""Helpers that need no session, against plain Python."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from examlake.llm import arc_warc, bpe, dart_minhash, decontaminate, license_scan, pitman_yor, words
from examlake.llm.exact_dedup import PatriciaTrie

TEXTS = ["", " ", "a", "Ab ab\tAB", "x" * 3000, "één déjà vu\r\n", "  lead", "trail  ", "ünïcode　wide\x85next", "a b c d e f g"]


def test_word_hashes_agree_with_split():
    hashes, offsets = words.word_hashes(pa.array(TEXTS))
    seen = {}
    for i, t in enumerate(TEXTS):
        own = t.encode().lower().split()
        assert len(own) == offsets[i + 1] - offsets[i]
        for w, h in zip(own, hashes[offsets[i] : offsets[i + 1]], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_of_slices_and_no_rows():
    col = pa.array(TEXTS)
    whole, offsets = words.word_hashes(col)
    part, _ = words.word_hashes(col.slice(3, 4))
    assert (part == whole[offsets[3] : offsets[7]]).all()
    assert len(words.word_hashes(pa.array([], pa.string()))[0]) == 0


def test_shingles_stay_within_texts():
    hashes, offsets = words.shingle_hashes(*words.word_hashes(pa.array(["a b c d e f", "b c", "", "a b c d e"])))
    assert np.diff(offsets).tolist() == [2, 1, 0, 1]
    assert hashes[0] == hashes[3]


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_what_the_library_gives(codec):
    own, library = codec
    rng = random.Random(5)
    signs = "ab \n\t  '´éß漢字\x1c\x85\xa0　!?.12½²tđ🙂\r\x0bsre"
    some = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["ab" * 2000, " " * 200, "漢" * 500, "<|endoftext|>"]
    for text, ids in zip(some, own.encode_batch(some), strict=True):
        assert ids == np.array(library.encode_ordinary(text), "<u4").tobytes()
        assert own.decode(ids) == text.encode()


def test_trie_counts_and_owners_with_and_without_spill():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for limit in (1 << 30, 4000):
        trie, want = PatriciaTrie(limit), {}
        for i, k in enumerate(keys):
            owner = (-rng.randint(0, 3), i, i, 1)
            trie.insert(k, owner)
            old = want.get(k)
            want[k] = owner if old is None else (*min(old[:3], owner[:3]), old[3] + 1)
        assert dict(trie.items()) == want
        rng.seed(1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_edit_search_against_all_stretches():
    rng = random.Random(2)
    for _ in range(300):
        p, t = (bytes(rng.choice(b"ab") for _ in range(rng.randint(1, n))) for n in (6, 10))
        best = min(distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        got = decontaminate.edit_search(p, t, 4)
        assert (got[0] if got else None) == (best if best <= 4 else None)


def test_matcher_finds_all_within_the_budget():
    rng = random.Random(3)
    item = b" ".join(bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(30))
    matcher = decontaminate.Matcher([(7, item)], 0.08)
    budget = int(len(item) * 0.08)
    for edits in (0, 1, budget // 2):
        text = bytearray(item)
        for _ in range(edits):
            text[rng.randrange(len(text))] = ord("z")
        hits = list(matcher.find(b"some words " + bytes(text) + b" more"))
        assert len(hits) == 1 and hits[0][0] == 7 and hits[0][1] <= edits
    # insertions, deletions and substitutions up to the whole budget
    for trial in range(30):
        text = bytearray(item)
        for _ in range(budget):
            at, kind = rng.randrange(1, len(text) - 1), rng.randrange(3)
            text[at : at + (kind > 0)] = b"" if kind == 1 else b"z"
        hits = list(matcher.find(b"some words " + bytes(text) + b" more"))
        assert len(hits) == 1 and hits[0][1] <= budget and hits[0][3] == 1, trial
    assert not list(matcher.find(b"nothing of the kind " * 20))
    # two places, the nearer one given; words of other words are none
    near = bytearray(item)
    near[5] = ord("z")
    ((_, distance_, _, places, start, end),) = matcher.find(bytes(near) + b" and " + item)
    assert (distance_, places) == (0, 2) and (bytes(near) + b" and " + item)[start:end] == item
    short = decontaminate.Matcher([(1, b"art")], 0.07)
    assert not list(short.find(b"the party starts")) and [h[3:] for h in short.find(b"art and art")] == [(2, 0, 3)]
    assert not list(decontaminate.Matcher([], 0.08).find(b"x"))


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    for share in (0.01, 0.03):
        other = [w if rng.random() > share else "new" + w for w in base]
        a, b = pa.array([" ".join(base)]), pa.array([" ".join(other)])
        e, w, d, _ = dart_minhash.weighted_elements(pa.concat_arrays([a, b]))
        s = dart_minhash.dart_signatures(e, w, d, 2, 1024)
        assert abs((s[0] == s[1]).mean() - dart_minhash.weighted_jaccard(a, b)[0]) < 0.06


def test_weighted_jaccard_against_counters():
    from collections import Counter

    def plain(x, y):
        c = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in (x.split(), y.split())]
        total = sum((c[0] | c[1]).values())
        return sum((c[0] & c[1]).values()) / total if total else 1.0

    pairs = [("a b c d e f g a b c d e f g", "a b c d e f g"), ("", ""), ("a", "a"), ("a b", "a c"), ("", "a")]
    got = dart_minhash.weighted_jaccard(pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs]))
    assert np.allclose(got, [plain(x, y) for x, y in pairs])


def test_tiles_join_what_pairs_join():
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    some = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(120)] = f"z{rng.randint(0, 40)}"
        some.append(" ".join(w + w[:40] * (i % 5 == 0)))
    comp = np.arange(60) % 25
    got = dart_minhash.tile_links(pa.table({"node": pa.array(np.arange(60)), "comp": pa.array(comp), "text": pa.array(some)}))
    want = set()
    for i in range(60):
        near = dart_minhash.weighted_jaccard(pa.array([some[i]] * 60), pa.array(some)) >= 0.8
        want |= {(i, j) for j in range(i + 1, 60) if near[j] and comp[i] != comp[j]}
    links = set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))

    def parts(pairs):
        owner = list(range(25))
        for a, b in pairs:
            x, y = owner[comp[a]], owner[comp[b]]
            owner = [x if o == y else o for o in owner]
        return {tuple(o == p for o in owner) for p in owner}

    assert links <= want and len(links) < 25 and parts(links) == parts(want)


def test_seating_keeps_its_bounds():
    rng = np.random.default_rng(0)
    customers = rng.integers(0, 500, 400)
    tables = pitman_yor.seat(customers, np.full(400, 30.0), np.full(400, 0.01), rng)
    assert (tables <= customers).all() and ((tables > 0) == (customers > 0)).all()


def test_seating_in_groups_is_near_seating_one_by_one():
    for others, dish in ((10.0, 0.3), (1000.0, 0.01), (1e5, 1e-4)):
        grouped = pitman_yor.seat(np.full(2000, 4000), np.full(2000, others), np.full(2000, dish), np.random.default_rng(1))
        tables, rng = np.ones(2000), np.random.default_rng(2)
        for i in range(1, 4000):
            fresh = (pitman_yor.STRENGTH + pitman_yor.DISCOUNT * (others + tables)) * dish
            tables += rng.random(2000) < fresh / (i - pitman_yor.DISCOUNT * tables + fresh)
        assert abs(grouped.mean() / tables.mean() - 1) < 0.01 and abs(grouped.std() / tables.std() - 1) < 0.1


def test_arc_versions_and_bodies_that_look_like_headers():
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 3\r\n\r\nfiledesc://x 0.0.0.0 1 text/plain 99\nWARC/1.1\r\n"
    for version, extra in ((1, ""), (2, " 200 - - 0 f.arc")):
        data = arc_warc._version_block(version).encode() + f"http://a/ 1.2.3.4 20240102030405 text/html{extra} {len(body)}\n".encode() + body + b"\n"
        assert [r[:4] for r in arc_warc.parse_arc(data)] == [("http://a/", "20240102030405", "text/html", body)]
        with pytest.raises(ValueError, match="shorter"):
            list(arc_warc.parse_arc(data[:-10]))
    with pytest.raises(ValueError, match="version"):
        list(arc_warc.parse_arc(b"http://a/ 1.2.3.4 20240102030405 text/html 0\n\n"))


def test_license_rules_compile_and_are_many():
    import re

    found = license_scan.rules()
    assert len(found) > 200 and all(r.priority in license_scan.WEIGHTS and re.compile(r.pattern) for r in found)


def test_owners_are_settled_in_parts(monkeypatch):
    from examlake.llm import exact_dedup

    rng = random.Random(8)
    rows = [(i, rng.choice(["a b", "ab", "c", "", None, "c  ", "d" * 50]), "x") for i in range(200)]
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows]})
    for held in (1, 2000, 1 << 20):
        monkeypatch.setattr(exact_dedup, "HELD_BYTES", held)
        here = pa.Table.from_batches(exact_dedup._keep_here(iter(table.to_batches(max_chunksize=9))))
        dealt = here.sort_by([("_length", "ascending"), ("_hash", "ascending")])
        for size in (1, 4, 1000):
            got = pa.Table.from_batches(exact_dedup._keep_each(iter(dealt.to_batches(max_chunksize=size)))).to_pydict()
            want = {}
            for i, t, _ in rows:
                key = (t or "").replace(" ", "")
                want[key] = min(want.get(key, (0, 1 << 60)), (-len(t or ""), i))
            assert sorted(got["doc_id"]) == sorted(i for _, i in want.values()) and set(got) == {"doc_id", "text", "lang"}
