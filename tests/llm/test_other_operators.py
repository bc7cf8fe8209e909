"""WARC, media, pages, vectors and the pipeline: small tables against brute force and round trips."""

import base64
import gzip
import hashlib
import io
import random
import struct
import time
import wave
import zipfile
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rangeweave.llm import common, media, pages, queries, vectors, warc


def page_table(spark, rows):
    """(page_id, url, html) with clashing extra columns."""
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, payload int")


# --- WARC ------------------------------------------------------------------------------------


def brute_captures(rows, least=0):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        first = max(same, default=None)
        revisit = len(raw) >= least and len([1 for _, _, h in rows if (h or "").encode() == raw]) > 1 and first is not None and i != first
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


WEIRD = [
    (1, "http://a.example/x?y=1", "<p>é</p>"),
    (2, "http://a.example/", "<p>é</p>"),
    (3, None, None),
    (4, "not a url\r\nEvil: 1", ""),
    (5, "http://b/", "x\r\n\r\nWARC/1.1\r\n\r\ny"),
    (6, "http://b/", "<p>é</p>"),
    (6, "http://b/", "<p>é</p>"),
    (None, "http://c/", "<p>é</p>"),
    (None, "http://c/", "alone"),
    (7, "http://d/", "long " * 60_000),
    (8, "http://d/", "\x1f\x00�"),
]


@pytest.mark.parametrize("least", [0, 9])
def test_captures_equal_brute_force(spark, least):
    got = warc.captures(page_table(spark, WEIRD), least=least)
    rows = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()), key=repr)
    assert rows == brute_captures(WEIRD, least)


def test_archives_are_gzip_files_of_warc_records(spark):
    path = common.scratch(spark)
    warc.write(page_table(spark, WEIRD[:5]), path)
    kinds = []
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        data = gzip.decompress(bytes(r["content"]))
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert rest[n : n + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            data = rest[n + 4 :]
    assert sorted(kinds) == sorted(["request"] * 5 + ["metadata"] * 5 + ["response"] * 3 + ["revisit"] * 2)


def test_assembly_nests_all_parts_and_payloads(spark):
    path = common.scratch(spark)
    warc.write(page_table(spark, WEIRD[:2]), path)
    got = {r["metadata"]["fields"]["page-id"]: r for r in warc.assemble(warc.read(spark, path)).collect()}
    assert bytes(got["2"]["response"]["payload"]).decode() == "<p>é</p>"
    assert got["1"]["response"]["payload"] is None
    assert got["1"]["response"]["kind"] == "revisit"
    assert all(r["request"]["record_id"] for r in got.values())
    partial = warc.assemble(warc.read(spark, path).where("kind <> 'request'")).collect()
    assert all(r["request"] is None for r in partial)


def test_archives_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 20_000)
    rng = random.Random(1)
    rows = [(i, "http://h/x", "".join(rng.choices("abcdefgh", k=10_000))) for i in range(40)]
    path = f"file://{tmp_path}/archives"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    files = list((tmp_path / "archives").rglob("part-*.txt"))
    assert len(files) > 5 and max(f.stat().st_size for f in files) < 30_000
    assert sorted(len(r["payload"]) for r in warc.read(spark, path).where("kind = 'response'").collect()) == [10_000] * 40


def test_captures_of_nothing_and_bad_archives(spark):
    assert warc.captures(page_table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="gzip"):
        list(warc.members(b"no archive"))
    with pytest.raises(ValueError, match="WARC"):
        warc.parse(b"HTTP/1.1 200\r\n\r\n")
    with pytest.raises(ValueError, match="shorter"):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")


# --- media -----------------------------------------------------------------------------------


def png(w=3):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1))) + chunk(b"IEND", b"")


def samples():
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", "hello")
    sound = io.BytesIO()
    with wave.open(sound, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(b"\x80" * 10)
    return {
        "image/png": png(),
        "image/gif": b"GIF89a\x01\x00\x01\x00\x80\x00\x00\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;",
        "image/jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02scan\xff\x00\xff\xd9",
        "image/bmp": b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 28,
        "application/pdf": b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF",
        "application/zip": box.getvalue(),
        "application/gzip": gzip.compress(b"hello"),
        "audio/wav": sound.getvalue(),
        "audio/ogg": b"OggS\0\x02" + b"\0" * 20 + b"\x01\x03abc" + b"OggS\0\x04" + b"\0" * 20 + b"\x01\x01z",
        "audio/flac": b"fLaC\x80\0\0\x22" + b"\0" * 34,
        "video/mp4": struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 12, b"mdat") + b"data",
        "image/webp": b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd",
        "video/x-msvideo": b"RIFF" + struct.pack("<I", 16) + b"AVI LIST" + struct.pack("<I", 4) + b"abcd",
    }


@pytest.mark.parametrize("kind", sorted(samples()))
def test_each_format_is_confirmed_embedded_and_refused_when_cut(kind):
    data = samples()[kind]
    assert media.describe(data) == (kind, [])
    found = media.sniff(b"junk BM RIFF \xff\xd8\xff PK\x03\x04" + data + b"")
    assert [(media.TYPES[n], at, size) for n, at, size in found] == [(kind, 21, len(data))]
    if kind != "audio/flac":
        assert media.describe(data[:-1])[0] == "application/octet-stream"


def test_magic_over_slices_is_found(monkeypatch):
    monkeypatch.setattr(media, "_SLICE", 16)
    for shift in range(20):
        assert media.sniff(b"." * shift + png()) == [("png", shift, len(png()))]


def test_texts_full_of_magic_numbers_are_not_searched_to_the_end_for_each():
    for part in (b"%PDF-1 ", b"PK\x03\x04PK\x05\x06", b"GIF89a!!!!!!!!!!"):
        for tail in (b"", b"%%EOF"):
            began = time.time()
            assert media.sniff(part * 150_000 + tail) == []
            assert time.time() - began < 20


def test_indexed_validators_equal_a_plain_search():
    rng = random.Random(4)
    parts = [b"%PDF-1", b"%PDF-x", b"startxref", b"%%EOF", b"start", b".", samples()["application/zip"], samples()["application/zip"][:-1], b"PK\x03\x04", samples()["image/gif"], b"GIF89a!!", b"\0"]

    def pdf(d, i):
        end = d.find(b"%%EOF", i)
        return end + 5 - i if d[i + 5 : i + 6].isdigit() and end >= 0 and d.find(b"startxref", i, end) >= 0 else 0

    def archive(d, i):
        own = samples()["application/zip"]
        return len(own) if d.startswith(own, i) else 0

    for _ in range(300):
        d = b"".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        for i in range(len(d)):
            if d.startswith(b"%PDF-", i):
                assert media._pdf(d, i) == pdf(d, i)
            if d.startswith(b"PK\x03\x04", i):
                assert media._zip(d, i) == archive(d, i)
            if d.startswith(samples()["image/gif"], i):
                assert media._gif(d, i) == len(samples()["image/gif"])


def test_inspection_and_carving(spark):
    rows = [(1, png() + b"tail" + samples()["image/gif"], "image/jpeg", "x"), (2, b"", "text/plain", "x"), (3, None, "text/plain", "x"), (4, b"text", "application/octet-stream", "x")]
    df = media.inspect(spark.createDataFrame(rows, "k long, media binary, declared string, embedded string"))
    got = {r["k"]: r for r in df.collect()}
    assert (got[1]["media_type"], got[1]["corrected"], len(got[1]["embedded"])) == ("image/png", True, 1)
    assert (got[2]["media_type"], got[3]["media_type"]) == ("application/octet-stream", None)
    assert not got[4]["corrected"]
    cut = media.carve(df).collect()
    assert [(r["k"], r["media_type"], bytes(r["media"])) for r in cut] == [(1, "image/gif", samples()["image/gif"])]


def test_features_equal_brute_force(spark):
    texts = ["", None, "a", "é" * 32, "b" * 64, "c" * 65, "x" * 200_000, "a", "RIFF%PDF-1 BM"]
    df = spark.createDataFrame([(i if i < 8 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = media.features(df).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = by[i if i < 8 else None]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.to_wav(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        with wave.open(io.BytesIO(stored)) as w:
            assert w.readframes(w.getnframes()) == payload
        assert r["feature"].startswith(f"audio/wav+0:{len(stored)}")
    assert by[2]["feature"] == by[7]["feature"]
    assert all(r["corrected"] and r["media_type"] == "audio/wav" and not r["carved"] for r in got)
    assert media.features(df.where("false")).count() == 0


def test_features_carve_what_a_text_holds(spark):
    inner = samples()["application/pdf"]
    got = media.features(spark.createDataFrame([(1, "before " + inner.decode() + " after")], "doc_id long, text string")).collect()
    assert [r.asDict() for r in got[0]["carved"]] == [{"media_type": "application/pdf", "offset": 51, "length": len(inner), "sha256": hashlib.sha256(inner).hexdigest()}]


# --- pages -----------------------------------------------------------------------------------


def main_text(html):
    return "\n".join(pages.blocks(html)[0])


def test_article_of_a_page():
    html = """<!DOCTYPE html><html><head><title>no</title><script>var a="</p>";</script><style>p{}</style></head><body>
    <nav><ul><li>menu</ul></nav><!-- no <p>hidden</p> --><div class="ad banner">buy</div><div id="cookie-notice">ok?</div>
    <article><h1>Title &amp; more</h1><p>One <b>bold</b>&nbsp;word<br>and<!-- x --> on.<p>Two &lt;tag&gt;&copy;<ul><li>first<li>second</ul>
    <form><input value=q>send</form><aside>aside</aside><section id=comments><p>first!</p></section></article>
    <div class=sidebar>side</div><footer>foot</footer></body></html>"""
    assert main_text(html).split("\n") == ["Title & more", "One bold word and on.", "Two <tag>©", "first", "second"]


def test_pages_without_article_and_broken_ones():
    assert main_text("<div>a<div>b</div>c</div><header>no</header><p>d") == "a\nb\nc\nd"
    assert main_text("<main><p>x</main><p>y") == "x"
    assert main_text("plain &amp; text") == "plain & text"
    assert main_text("") == main_text(None) == ""
    assert main_text("<article><p>cut <a href='x") .startswith("cut")
    assert main_text("<article><script>never closed <p>a") == ""
    assert main_text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert main_text("<article><p>a</article><article class=comment><p>b</article>") == "a"


def test_templates_of_a_host_go_and_copies_do_not_make_them(spark):
    rows = []
    for k in range(14):
        rows.append((k, "http://Host.example/a", f"<div><div>Sister sites of ours</div><p>text number {k}</p></div>"))
    rows += [(20 + k, "http://copy.example/", "<div><p>same</p><div>own</div></div>") for k in range(30)]
    rows += [(60, "http://other.example/x", "<div><div>Sister sites of ours</div><p>text</p></div>"), (61, None, None), (None, "http://host.example/", "<article><p>a</p></article>"), (61, None, None)]
    rows += [(100 + k, "http://art.example/", f"<article><h1>Same heading</h1><p>{k}</p><div>Read on</div></article>") for k in range(12)]
    got = {}
    for r in pages.extract(page_table(spark, rows)).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append(r["text"])
    assert all(got[k] == [f"text number {k}"] for k in range(14))
    assert all(got[20 + k] == ["same\nown"] for k in range(30))
    assert got[60] == ["Sister sites of ours\ntext"]
    assert got[61] == ["", ""]
    assert got[None] == ["a"]
    assert all(got[100 + k] == [f"Same heading\n{k}"] for k in range(12))
    assert pages.extract(page_table(spark, [])).count() == 0


def test_classes_that_say_something_else_keep_their_text():
    for html in (
        '<div class="site has-sidebar"><p>text of the page</p></div>',
        '<article class="post no-sidebar"><p>text of the page</p></article>',
        '<div class="post share-enabled"><p>text of the page</p></div>',
        '<article><section id="search-algorithms"><p>text of the page</p></section></article>',
        '<form id="aspnet"><input type="hidden"><div><article><p>text of the page</p></article></div></form>',
        '<form><input type="hidden"><p>text of the page</p></form>',
        '<div class="main-wrapper"><p>text of the page</p></div>',
    ):
        assert main_text(html) == "text of the page", html
    short = "<article><p>a</p></article><section id=comments>" + "<article><p>a long remark of a reader</p></article>" * 9 + "</section>"
    assert main_text(short) == "a"
    for name in ("cookie-notice", "site-header", "main-nav", "comment-list", "ad", "ad2", "social share"):
        assert pages.told(name), name


def brute_extract(rows, share=0.3, few=3, many=10):
    """Counting with plain dictionaries over the blocks of every page."""
    parts, hosts, seen = [], {}, {}
    for _, url, html in rows:
        host = url.split("://", 1)[1].split("/")[0].lower() if url else ""
        got = pages.blocks(html)
        parts.append((host, got))
        hosts.setdefault(host, set()).add(tuple(got[0]))
        for h in got[2]:
            seen.setdefault((host, h), set()).add(tuple(got[0]))
    out = []
    for host, (texts, chains, _) in parts:
        gone = lambda h, host=host: len(seen[host, h]) >= max(many if h % 2 else few, share * len(hosts[host]))
        out.append("\n".join(t for t, c in zip(texts, chains, strict=True) if not any(map(gone, c))))
    return out


def test_templates_go_by_counting_only(spark):
    """Blocks of no telling tag or class, in and out of articles, by brute force; fewer pages keep them."""
    rng, rows = random.Random(5), []
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(6))
    for k in range(40):
        shared = "".join(f"<p>{x}</p>" for x in ("about us", "read more") if rng.random() < 0.8)
        rows.append((len(rows), "http://many.example/x", f"<article><h1>The title</h1><p>{word()} {word()}</p>{shared}<ul><li>{rng.choice(['one', 'two'])}<li>{word()}</ul></article>"))
        rows.append((len(rows), "http://bare.example/x", f"<div><div><p>all our sites</p></div><p>{word()}</p>{'<p>rare</p>' if k < 2 else ''}</div>"))
    rows += [(len(rows) + k, "http://less.example/", f"<article><p>{k}</p><p>about us</p></article>") for k in range(9)]
    got = {r["page_id"]: r["text"] for r in pages.extract(page_table(spark, rows)).collect()}
    want = brute_extract(rows)
    assert [got[i] for i in range(len(rows))] == want
    plain = ["\n".join(pages.blocks(h)[0]) for _, _, h in rows]
    changed = sum(a != b for a, b in zip(want, plain, strict=True))
    assert changed >= 60
    assert not any("about us" in t or "all our sites" in t for t in want[:80])
    assert all("The title" in t for t in want[:80:2])
    assert sum("rare" in t for t in want) == 2
    assert want[80:] == plain[80:]


# --- vectors ---------------------------------------------------------------------------------


def test_plans_reach_the_recall_they_are_set_for():
    """Pairs just at the threshold, drawn at random, collide often enough; strangers rarely do."""
    rng = np.random.default_rng(4)
    for n in (10, 10**4, 10**7):
        lines, cut, half, need = vectors.plan_for(n, 16)
        trials, hits = 2000, np.zeros((2, 2000), dtype=np.int64)
        for _ in range(-(-lines // 2000)):
            x = rng.standard_normal((trials, min(lines, 2000)))
            z = rng.standard_normal(x.shape)
            for k, c in enumerate((0.9, 0.0)):
                y = c * x + np.sqrt(1 - c * c) * z
                hits[k] += ((x * y > 0) & (np.abs(x) >= cut) & (np.abs(y) >= cut) & (np.abs(x - y) <= half)).sum(axis=1)
        assert (hits[0] >= need).mean() >= vectors.RECALL - 0.01, n
        if n >= 10**4:
            assert (hits[1] >= need).mean() < 0.2
        if lines > 50_000:
            break


@pytest.mark.parametrize("block", [40, 1000])
def test_links_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng, x = np.random.default_rng(5), []
    for _ in range(60):
        centre = rng.standard_normal(32)
        for _ in range(rng.integers(1, 9)):
            x.append(centre + rng.standard_normal(32) * rng.choice([1e-7, 0.1, 0.3]))
    hot = rng.standard_normal(32)
    x += [hot + 1e-7 * rng.standard_normal(32) for _ in range(150)] + [hot] * 20
    x = np.array(x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T) >= 0.9
    np.fill_diagonal(links, False)
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [1.0] * 3), (9004, [2.0] * 3), (9005, []), (9006, [None, 1.0]), (9007, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v.tolist(), "c", 1) for i, v in enumerate(x)] + [(i, v, "c", 1) for i, v in odd], "vec_id long, embedding array<double>, rid string, key int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(x) + len(odd)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= links.sum(axis=1)).all()
    assert n[-170:].tolist() == [169] * 170
    assert n[:-170].sum() >= 0.9 * links[:-170].sum()
    assert {i: (got[i]["n_links"], got[i]["kept"]) for i, _ in odd} == {9000: (0, True), 9001: (0, True), 9002: (0, True), 9003: (1, True), 9004: (1, False), 9005: (0, True), 9006: (0, True), 9007: (0, True)}
    for r in got.values():
        assert r["component_id"] <= r["vec_id"]
        assert r["kept"] == (r["component_id"] == r["vec_id"])


def test_doubtful_balls_are_resolved_by_their_members(spark, monkeypatch):
    """Balls of a wide radius around the threshold: no count too high, and nine of ten links found."""
    rng, x = np.random.default_rng(6), []
    base = np.eye(8)[0]
    for angle in (0.0, 0.44, 0.45, 0.46):
        centre = np.cos(angle) * base + np.sin(angle) * np.eye(8)[1]
        x += [centre + 0.002 * rng.standard_normal(8) for _ in range(12)]
    x = np.array(x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T) >= 0.9
    np.fill_diagonal(links, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for _ in range(2):
        n = np.array([r["n_links"] for r in sorted(vectors.near_duplicates(df, epsilon=0.02).collect())])
        assert (n <= links.sum(axis=1)).all()
        assert n.sum() >= 0.9 * links.sum()
        monkeypatch.setattr(vectors, "BLOCK", 5)  # members in several blocks


def test_near_copies_of_real_vectors_equal_brute_force(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    rng = np.random.default_rng(8)
    x = np.array([v for _, v in rows])
    x = np.concatenate([x, *(x[:150] + s * rng.standard_normal((150, x.shape[1])) for s in (0.02, 0.04, 0.055))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T) >= 0.9
    np.fill_diagonal(links, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    n = np.array([r["n_links"] for r in sorted(vectors.near_duplicates(df).collect())])
    assert links.sum() > 300
    assert (n <= links.sum(axis=1)).all()
    assert n.sum() >= 0.95 * links.sum()


def test_vectors_of_nothing_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect())
    assert got == [(-1, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]
    assert vectors.near_duplicates(df.where("false")).count() == 0


# --- pipeline --------------------------------------------------------------------------------


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rng = random.Random(1)
    odd = spark.createDataFrame([(9_000_001, None, "en", "src0", None), (9_000_002, "123 !!", None, "src0", 6), (9_000_003, " ".join(f"the and of {rng.random()}" for _ in range(30)), None, None, 9)], docs.schema)
    docs = docs.unionByName(odd)
    before, ids = docs, None
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = common.stage(step(spark, before, DATA))
        assert after.columns == docs.columns, name
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}, name
        if name == "language_id":
            assert not {9_000_001, 9_000_002} & ids
            assert after.count() >= docs.count() - 2
        if name == "simhash_near_dedup":
            assert after.count() == after.select("doc_id").distinct().count()
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, DATA).collect()
    assert len(out) == before.count()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in out[:40]:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_queries_are_registered_and_only_the_entry_module_guards():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in e.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert F is not None


def test_collisions_are_counted_without_a_row_a_pair_and_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(line << 20 | 4, rid, float(x)) for line in range(30) for rid, x in zip(rng.choice(300, 60, replace=False).tolist(), rng.random(60) * 40, strict=True)]
    df = spark.createDataFrame(rows, "line long, rid long, value float")
    found = vectors._collisions(df, {4: (30, 0.0, 0.5, 2)})
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    met: dict = {}
    for line in range(30):
        own = [(r, np.float32(x)) for k, r, x in rows if k == line << 20 | 4]
        for i, (p, x) in enumerate(own):
            for q, y in own[i + 1 :]:
                if abs(x - y) <= np.float32(0.5):
                    met[min(p, q), max(p, q)] = met.get((min(p, q), max(p, q)), 0) + 1
    want = sorted(k for k, n in met.items() if n >= 2)
    assert sorted(map(tuple, found.collect())) == want and want


def test_unit_rows_of_odd_and_plain_vectors():
    rows = [[3.0, 4.0], None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1e300, 1e300], [2.0], [1e-300, 0.0]]
    got = vectors.unit_rows(pa.array([[9.0], *rows], pa.list_(pa.float64())).slice(1))
    assert [None if v is None else v.round(12).tolist() for v in got] == [[0.6, 0.8], None, None, None, None, None, None, [round(0.5**0.5, 12)] * 2, [1.0], [1.0, 0.0]]
