"""The operators against brute force, on small tables with nulls, ties, repeated rows, long texts and clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from eddyline.llm import exact_dedup, jaccard, licences, mixing, packing, pii, quality, substring_dedup, transport, url_rules
from eddyline.llm.queries import URL_RULES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, row string, digest string, kept boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(rng.randrange(1, 150)) for _ in range(60)]
    passage = prose(70)
    texts += [prose(20) + "\n" + passage + "\t" + prose(15) for _ in range(6)] + [texts[0].upper(), texts[0], texts[1] + " ", "", " \t\n", "one two", "one  two", passage]
    for t in texts[:20]:
        words = t.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += ["a " * 4000, "x" * 20_000]
    out = [(i, t, f"s{i % 3}", "r", "d", True) for i, t in enumerate(texts)]
    return out + [out[3], (900, None, None, None, None, None), (901, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_transport_round_trip(docs, empty, rows):
    got = {r.doc_id: r for r in transport.transport_digests(docs).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = transport.mux(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and "errors=0" in r.feature
    assert transport.transport_digests(empty).count() == 0


def test_transport_faults(spark):
    data = transport.mux(bytes(range(256)) * 400)
    whole = transport.demux(data)
    assert whole.programs == {1: transport.PMT_PID} and whole.streams == {transport.STREAM_PID: (1, transport.PRIVATE)}
    assert [u.pts for u in whole.units] == [k * transport.TICKS for k in range(len(whole.units))] and whole.units[0].random_access
    lost = transport.demux(data[: 188 * 10] + data[188 * 11 :])
    assert lost.continuity_errors == 1 and any(u.damaged for u in lost.units)
    twice = transport.demux(data[: 188 * 10] + data[188 * 9 : 188 * 10] + data[188 * 10 :])
    assert twice.repeated == 1 and b"".join(u.data for u in twice.units) == b"".join(u.data for u in whole.units)
    noisy = transport.demux(b"junk" + data)
    assert noisy.lost_bytes == 4 and len(noisy.units) == len(whole.units)
    broken = bytearray(data)
    broken[10] ^= 1
    assert transport.demux(bytes(broken)).table_errors == 1 and not transport.demux(b"").packets
    table = spark.createDataFrame([(1, bytes(data)), (2, None)], "key long, media binary")
    assert transport.parse_streams(table, "media", "key").count() == len(whole.units)
    assert {r.key: r.packets for r in transport.stream_report(table, "media", "key").collect()} == {1: len(data) // 188, 2: 0}


def test_exact(docs, empty, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[ascii_lower(t)].append(i)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    by = {r.doc_id: r for r in got}
    for t, ids in groups.items():
        for i in ids:
            assert (by[i].keep_id, by[i].group_size, by[i].text_sha256) == (max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(x) for x in groups.values())
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [2, 1024])
def test_jaccard(docs, empty, rows, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(ascii_lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(rows) and all((r.component_id, r.n_shingles) == (root(r.doc_id), len(sets[r.doc_id])) for r in got)
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_counts_every_link(spark):
    rng = random.Random(3)
    # Large groups of near copies: every pair of some links, of others only some pairs.
    texts = []
    for most in (2, 5):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for _ in range(25):
            own = list(base)
            for at in rng.sample(range(300), rng.randrange(1, most + 1)):
                own[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [texts[0], "one two", ""]
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))) if t else frozenset() for t in texts]
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    want = {i: sum(linked(own, other) for other in set(sets) - {own}) for i, own in enumerate(sets)}
    assert max(want.values()) == 24 and len(set(want.values())) > 4
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for members in (7, jaccard.MEMBERS):
        assert {r.doc_id: r.n_links for r in jaccard.near_duplicates(table, members=members).collect()} == want


def test_url_rules(spark):
    urls = ["https://a.Example.org/es/x?y", "http://example.org/en/12#t", "https://x.org/en", "https://m.com/fr/1", "https://m.com/de", "https://m.com/de/a://b", "no scheme", None, "://", "https://org/", "https://notexample.org/es/"] * 2
    got = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnRenamed("url", "url"), URL_RULES).collect()
    want = ["example.org/es/", "example.org/en/1", "org/", "com/fr/", None, "com/de/", None, None, None, "org/", "org/"] * 2
    assert [r.rule for r in sorted(got, key=lambda r: r.page_id)] == want
    assert {r.verdict for r in got if r.rule in ("example.org/es/", "com/de/")} == {"block"}


def test_mixing(spark, docs, empty):
    weights = {"s0": 5, "s1": 2, mixing.REST: 1}
    for share in weights.values():
        assert share
    table = spark.createDataFrame([(i, f"t{i}", ("s0", "s1", "s2", None)[i % 4]) for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.schedule(table, weights, 4).toPandas()
    assert len(got) == 4000 and got["position"].is_unique and (got["slot"] >= got["release"]).all() and (got["slot"] < got["deadline"]).all()
    first = got.drop_duplicates(["stream", "block"]).sort_values("slot")
    given = dict.fromkeys(weights, 0)
    for n, stream in enumerate(first["stream"].iloc[:300], 1):  # no source has run out yet
        given[stream] += 1
        assert all(abs(given[s] - n * w / 8) < 1 for s, w in weights.items())
    assert sorted(r.doc_id for r in mixing.mixed(docs, weights).collect()) == sorted(r.doc_id for r in docs.collect())
    assert mixing.schedule(empty, weights).count() == 0


def test_quality(spark, docs, empty):
    rng = random.Random(2)
    words = [("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))) for _ in range(500)]
    good = [" ".join(rng.choice(words) for _ in range(80)).capitalize() + "." for _ in range(60)]
    bad = [" ".join(rng.choice(words).upper() + "!!" for _ in range(80)) for _ in range(20)] + [" ".join([rng.choice(words)] * 80) for _ in range(20)]
    table = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = {r.doc_id: r.keep for r in quality.classify(table).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 100))
    assert len(quality.classify(docs).collect()) == docs.count() and quality.classify(empty).count() == 0
    kept = quality.good_documents(docs)
    assert kept.columns == docs.columns and "x" * 20_000 not in {r.text for r in kept.where("doc_id > 899").collect()}


def test_licences(docs, empty, spark):
    table = spark.createDataFrame([(1, "prose here\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "The license plate was free of charge."), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(table).collect()}
    assert got[1].licences == ["Apache-2.0"] and got[1].hits[0].line == 1 and got[1].hits[0].start == 11 and not got[2].licences and not got[3].n_paragraphs
    assert licences.model().accuracy > 0.9 and licences.scan(docs).count() == docs.count() and licences.scan(empty).count() == 0


GPL = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{1} either version {2} of the License, or
    (at your option) any later version."""


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_licences_wrapped(mark):
    notices = {
        "GPL-3.0": GPL.format(":", ",", 3),
        "GPL-2.0": GPL.format(";", ";", 2),
        "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software",
        "MPL-2.0": "This Source Code Form is subject to the terms of the\nMozilla Public License, v. 2.0. If a copy of the MPL was not",
    }
    for family, notice in notices.items():
        text = "prose of the house\nand more\n\n" + "\n".join(mark + line for line in notice.split("\n")) + "\n\nthe end of the general story"
        hits = licences.model().scan(text)
        assert [(h[0], h[1], h[2]) for h in hits] in ([(3, 29, family)], [(4, 29 + len(mark) + len(notice.split("\n")[0]) + 1, family)]), (family, hits)
    prose = "\n".join(licences.OTHERS)
    assert not licences.model().scan(prose)


def test_substring(docs, empty, rows):
    ordered = sorted(set((i, t) for i, t, *_ in rows))
    first, want = {}, {}
    for i, t in ordered:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows) and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got) and any(x[1] for x in want.values())
    assert substring_dedup.remove_repeats(empty).count() == 0 and substring_dedup.maximal_repeats(docs).count() > 0


def test_pii(spark, docs, empty):
    text = "x a@b.c_d@e.f 😀1.2.3.4.5 999.1.1.1 to 4111 1111 1111 1111 +1 (222) 333-4444 call (555) 123-4567 order 555-123-4567"
    got = pii.span_digests(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (2, 1, 1, 1)
    base = "email:2:7,email:7:13,ip:15:22,card:38:57,phone:58:75"
    assert one.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and "phone:81:95" in one.spans and "phone:102" not in one.spans
    assert pii.span_digests(docs).count() == docs.count() and pii.span_digests(empty).count() == 0


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = packing.pack_documents(docs, tokenizer_path(), group=16).toPandas()
    want = []
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 2048 and (own["offset"].to_numpy() == np.r_[0, np.cumsum(own["length"])[:-1]]).all()
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0
    lengths = np.array([1025] * 10 + [1024] * 5)
    assert packing.lower_bound(lengths) == 13
