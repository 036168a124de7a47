"""Url parts, rules and verdicts; stored media round trips and features of known signals."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tessera.llm import media, urls


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


GIVEN = ["https://a.Example.com/en/1", "http://x.example.com/en/70?q", "https://x.example.net/de/5", "https://x.example.net/de/81#t", "http://www.example.org/es/", "http://notcom/en/", "https://b.com?x=/en/", None, "no scheme", "://", "http://É.com/en/\nx", "https://blog.casino-win.example.net/en/1", "http://m.freebets.example.net/en/27", "https://therin.example.net/en/48", "http://casino", "https://blog.casino-win.example.net/en/1"]


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(GIVEN)], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, u in enumerate(GIVEN):
        assert (got[i].host, got[i].path) == parts(u), u
    assert [got[i].rule for i in range(7)] == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/", None, None]
    assert [got[i].verdict for i in range(5)] == ["block", "allow", "allow", "block", "block"]
    assert [got[i].verdict for i in (7, 8, 11, 12, 13, 14)] == ["allow", "allow", "block", "block", "allow", "block"]
    assert got[11][1:] == got[15][1:]  # repeated rows
    assert urls.judge(pages.limit(0)).count() == 0 and urls.judge(pages.limit(0), urls.fit(pages.limit(0))).count() == 0


def test_the_longest_rule_wins_and_the_longer_host_of_a_tie():
    rules = {"com": [("/ab", "block")], "x.com": [("/", "allow")], "y.x.com": [("/b", "block")]}
    assert urls.longest_rule(rules, "x.com", "/ab") == ("x.com/", "allow", "", "ab")
    assert urls.longest_rule(rules, "a.x.com", "/abc") == ("x.com/", "allow", "a", "abc")
    assert urls.longest_rule({"com": [("/abc", "block")], "x.com": [("/a", "allow")]}, "x.com", "/abc")[0] == "x.com/a" and urls.longest_rule({"com": [("/abcd", "block")], "x.com": [("/a", "allow")]}, "x.com", "/abcd")[0] == "com/abcd"
    assert urls.longest_rule(rules, "", "/ab") == (None, None, "", "/ab") and urls.longest_rule(rules, "ycom", "/ab")[0] is None


def plain_judge(rows):
    """(verdict, score) of each url: counts in loops, all splits of a run of letters tried."""
    from functools import cache

    text = Counter(w for _, _, html in rows if html for w in re.findall("[a-z]+", re.sub("(?s)<[^>]*>", " ", html).lower()) if len(w) <= urls.LONGEST)
    seeds = Counter(w for s in urls.SEEDS.values() for phrase in s.split("|") for w in phrase.split())
    counts = Counter({w: text[w] + urls.SEED_WEIGHT * seeds[w] for w in {*text, *seeds}})
    total = sum(counts.values())

    @cache
    def cut(s):
        """Cheapest cost and words of the letters."""
        if not s:
            return 0.0, ()
        best = None
        for k in range(max(0, len(s) - urls.LONGEST), len(s)):
            w, (c, ws) = s[k:], cut(s[:k])
            c += math.log(total / counts[w]) if counts[w] else math.log(total) + urls.UNKNOWN * len(w)
            if best is None or c < best[0] - 1e-12:
                best = c, (*ws, w)
        return best

    def words(host, path):
        return [w for run in re.findall("[a-z]+", host + " " + path.lower()) for w in cut(run)[1]]

    classes = {c: Counter({w: urls.SEED_WEIGHT * n for w, n in Counter(s.replace("|", " ").split()).items()}) for c, s in urls.SEEDS.items()}
    by_host = {}
    for v, h, p in sorted(urls.RULES, key=lambda r: -len(r[2])):
        by_host.setdefault(h, []).append((p, v))
    ruled = [urls.longest_rule(by_host, *parts(u)) for _, u, _ in rows]
    hosts = {}
    for (_, u, _), (_, v, host, path) in zip(rows, ruled, strict=True):
        for w in words(host, path) if v else ():
            hosts.setdefault(w, set()).add((v, parts(u)[0]))
    for w, found in hosts.items():
        if len({h for _, h in found}) >= urls.LEAST_HOSTS:
            for v, _ in found:
                classes[v][w] += 1
    known = {*classes["block"], *classes["allow"]}
    p = lambda c, w: (classes[c][w] + urls.SMOOTH) / (sum(classes[c].values()) + urls.SMOOTH * len(known))
    out = []
    for (_, u, _), (_, v, _, _) in zip(rows, ruled, strict=True):
        host, path = parts(u)
        score = math.log(urls.PRIOR["block"] / urls.PRIOR["allow"]) + sum(math.log(p("block", w) / p("allow", w)) for w in words(host.rpartition(".")[0] or host, path) if w in known)
        out.append((v or ("block" if score > 0 else "allow"), score))
    return out


def test_the_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").orderBy("page_id").collect()]
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    scores = [r.score for r in urls.judge(pages, urls.fit(pages)).orderBy("page_id").collect()]
    got = urls.op5_host_segmentation(spark, sf).orderBy("page_id").collect()
    want = plain_judge(rows)
    assert [r.verdict for r in got] == [v for v, _ in want]
    assert np.allclose(scores, [s for _, s in want], atol=1e-6)
    assert len({r.verdict for r in got if r.rule is None}) == 2


def test_segmentation_finds_the_cheapest_split():
    m = urls.Model()
    assert m.segment("cheappillsonline") == ["cheap", "pills", "online"]
    cost = lambda ws: sum(m.cost.get(w) or m.unknown + urls.UNKNOWN * len(w) for w in ws)

    def brute(s):
        return min(([s], *([s[:k], *brute(s[k:])] for k in range(1, len(s)))), key=cost)

    for s in ("freebets", "thenews", "xqz", "winads"):
        assert abs(cost(m.segment(s)) - cost(brute(s))) < 1e-9


def test_media_round_trip(spark, monkeypatch):
    texts = [None, "", "abc", "é" * 500, "abc", "long text " * 30_000, *(f"t{k}" for k in range(600))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, media string, spans int")
    whole = media.audio_features(docs)
    got = {r.doc_id: r for r in whole.collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        back, rate = media.read_back(bytes(r.media))
        assert back == padded and rate == media.RATE and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(padded), zlib.crc32(padded[-16:]), len(r.media))
    assert got[2].feature == got[4].feature != got[3].feature
    assert media.audio_features(docs.limit(0)).count() == 0
    # stored tensors: fixed shape, same values, same spans
    seen = 0
    for r in media.tensor_streams(whole).collect():
        table = pa.ipc.open_stream(io.BytesIO(bytes(r.stream))).read_all()
        assert isinstance(table["log_mel"].type, pa.FixedShapeTensorType) and table["log_mel"].type.shape == list(media.SHAPE)
        tensors, spans = media.from_stream(bytes(r.stream))
        for doc, tensor, ms in zip(r.doc_ids, tensors, spans, strict=True):
            assert tensor.reshape(-1).tolist() == got[doc].log_mel and ms.tolist() == [[s.start_ms, s.end_ms] for s in got[doc].spans]
            seen += 1
    assert seen == len(texts)
    digests = {r.doc_id: r.feature for r in media.audio_features(docs.repartition(3), keep=False).collect()}
    assert digests == {i: r.feature for i, r in got.items()}


def test_features_against_a_plain_version():
    rng = np.random.default_rng(3)
    raw = bytes(rng.integers(97, 123, 192 * 20, np.uint8))
    tensor, ms, n = media.Analyser()(raw)
    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    # resampling: each output is its windowed-sinc sum over the inputs around its place
    out = []
    for k in range(len(x) * media.UP // media.DOWN):
        at = (k // media.UP) * media.DOWN + (k % media.UP) * media.DOWN / media.UP
        total = weight = 0.0
        first = (k // media.UP) * media.DOWN - media.TAPS
        for j in range(first, first + 2 * media.TAPS + media.DOWN):
            t = j - at
            if abs(t) < media.TAPS:
                h = np.sinc(media.UP / media.DOWN * t) * (0.5 + 0.5 * np.cos(np.pi * t / media.TAPS))
                weight += h
                total += h * (x[j] if 0 <= j < len(x) else 0.0)
        out.append(total / weight)
    y, rate = np.array(out), media.RATE * media.UP / media.DOWN
    frames = [y[a : a + media.FRAME] * np.hanning(media.FRAME) for a in range(0, len(y) - media.FRAME + 1, media.HOP)]
    assert n == len(frames)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(2595 * np.log10(1 + 60 / 700), 2595 * np.log10(1 + rate / 2 / 700), media.MELS + 2)]
    mels = []
    for f in frames:
        row = []
        power = [abs((f * np.exp(-2j * np.pi * b * np.arange(media.FRAME) / media.FFT)).sum()) ** 2 for b in range(media.FFT // 2 + 1)]
        for lo, mid, hi in zip(edges, edges[1:], edges[2:], strict=False):
            w = [max(0.0, min((b * rate / media.FFT - lo) / (mid - lo), (hi - b * rate / media.FFT) / (hi - mid))) for b in range(media.FFT // 2 + 1)]
            row.append(np.log(np.dot(w, power) + 1e-6))
        mels.append(row)
    cuts = [k * n // media.SHAPE[0] for k in range(media.SHAPE[0])] + [n]
    want = np.array([np.mean(mels[a:b], axis=0) if b > a else mels[min(a, n - 1)] for a, b in zip(cuts, cuts[1:], strict=False)])
    assert np.abs(tensor - want).max() < 2e-3
    # spans: on above the upper threshold, off at or below the lower one, taken back to where the lower one was passed
    energy = [10 * np.log10((f**2).mean() + 1e-9) for f in frames]
    assert np.allclose((ms[:, 0] / 1000 * rate / media.HOP) % 1, 0) and len(ms) == len(plain_segments(energy))


def plain_segments(energy):
    low, high = np.quantile(energy, media.LOWER), np.quantile(energy, media.UPPER)
    out, start, loud = [], None, False
    for k, e in enumerate([*energy, -np.inf]):
        if e > low:
            start = k if start is None else start
            loud = loud or e > high
        else:
            if start is not None and loud:
                out.append((start, k))
            start, loud = None, False
    return out


def test_segments_against_a_plain_machine():
    rng = np.random.default_rng(4)
    for _ in range(200):
        e = rng.normal(size=rng.integers(3, 60)).round(1)
        assert media.Analyser().segments(e).tolist() == [list(s) for s in plain_segments(e)]


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000).astype(np.float32)
    y = media.Analyser().resample(x)
    want = np.sin(2 * np.pi * 440 * np.arange(12_000) / 12_000)
    assert len(y) == 12_000 and np.abs(y[50:-50] - want[50:-50]).max() < 0.02


def test_segments_have_hysteresis():
    e = np.array([0, 1, 1, 9, 2, 2, 0, 0, 1.5, 1.5, 0, 0, 0, 9, 9, 0])
    got = media.Analyser().segments(e)
    assert (3 >= got[:, 0]).any() and all(e[a:b].max() > np.quantile(e, media.UPPER) for a, b in got)
