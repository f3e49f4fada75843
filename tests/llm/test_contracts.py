"""Queries against brute-force versions over whole tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from gleaner.llm import pii, secrets
from gleaner.llm.queries import QUERIES

from tests.conftest import rows_of

NAMES = {n.split("_")[0]: n for n in QUERIES}
SPACE = " \t\n\x0b\x0c\r"


def result(spark, op, sf_dir, *columns):
    df = QUERIES[NAMES[op]](spark, sf_dir)
    return rows_of(df.select(*columns)) if columns else rows_of(df)


def ordered(rows):
    return sorted(rows, key=lambda t: [(x is not None, str(type(x)), x) for x in t])


def documents(spark, sf_dir):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def digest(spans, kinds):
    line = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return hashlib.sha256(line.encode()).hexdigest()


def base_secrets(t):
    out = []
    for m in re.finditer(r"""(?:%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")), t):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    for k, p, n in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[0]) >= n]
    return out


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if len(t) < 50_000 else []
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if len(t) < 50_000 else ():
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return out


def spans_of(text):
    return {tuple(x.split(":")) for x in text.split(",") if x}


def test_op2_base(spark, sf_dir):
    want = []
    for d, t in documents(spark, sf_dir):
        b = base_secrets(t or "")
        want.append((d, *(sum(x[1] == k for x in b) for k in range(3)), digest(b, secrets.KINDS)))
    assert result(spark, "op2", sf_dir, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == ordered(want)


def brute_entropy(word, w=secrets.WINDOW):
    best = 0.0
    for i in range(len(word) - w + 1):
        c = np.unique(list(word[i : i + w]), return_counts=True)[1] / w
        best = max(best, float(-(c * np.log2(c)).sum()))
    return best


def test_op2_spans(spark, sf_dir):
    """All base spans stay; entropy spans are those of a window-by-window sum."""
    got = {}
    for d, s in result(spark, "op2", sf_dir, "doc_id", "spans"):
        got.setdefault(d, []).append(spans_of(s))
    for d, t in documents(spark, sf_dir):
        t = t or ""
        base = base_secrets(t)
        want = {(secrets.KINDS[k], str(s), str(e)) for s, k, e in base}
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            limit = next(x for _, p, x in secrets.CLASSES if re.fullmatch(p.strip("^$"), m[0]))
            if not re.search("[0-9]", m[0]) or not re.search("[A-Za-z]", m[0]) or re.search(secrets.ALLOW.replace("(?i:", "(?i:"), m[0]):
                continue
            if brute_entropy(m[0][:3000]) > limit and not any(s < m.end() and m.start() < e for s, _, e in base):
                want.add(("entropy", str(m.start()), str(m.end())))
        assert want in got[d], (d, t[:80])


def test_op3(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = result(spark, "op3", sf_dir, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert [r[:3] for r in ordered([(r[0], r[1], r[2]) for r in rows])] == ordered([(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs])
    assert {(r[3], r[6]) for r in rows} == {("bytes", None)}
    total, largest = sum(r[1] for r in rows), max(r[1] for r in rows)
    for k in range(8):
        own = [r for r in rows if r[4] == k]
        assert sorted(r[5] for r in own) == list(range(len(own)))
        assert abs(sum(r[1] for r in own) - total / 8) <= largest
    in_order = sorted(rows, key=lambda r: (r[4], r[5]))
    ids = [r[0] if r[0] is not None else -(10**18) for r in in_order]
    assert ids == sorted(ids)


def brute_fingerprint(t, n=3):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in words(t)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    fps = np.array(sorted(set(fps)), np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return {int(f): find(i) for i, f in enumerate(fps)}


def test_op4(spark, sf_dir):
    docs = [(d, brute_fingerprint(t)) for d, t in documents(spark, sf_dir)]
    part = brute_components([f for _, f in docs], 2)
    least = {}
    for d, f in docs:
        if d is not None:
            least[part[f]] = min(d, least.get(part[f], d))
    want = [(d, f"{f:016x}", least.get(part[f])) for d, f in docs]
    assert result(spark, "op4", sf_dir, "doc_id", "fingerprint", "component_id") == ordered(want)


def test_op5(spark, sf_dir):
    pages = [(r[0], (r[1] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    best = {}
    for d, p in pages:
        best.setdefault(p, []).append(d)
    want = []
    for d, p in pages:
        top = max((x for x in best[p] if x is not None), default=None)
        revisit = len(best[p]) > 1 and d != top
        want.append((d, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert result(spark, "op5", sf_dir) == ordered(want)


def test_op6(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(d, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for d, t in documents(spark, sf_dir)]
    docs.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), zlib.crc32(x[1].astype("<u2").tobytes())))
    want, at = [], 0
    for d, ids in docs:
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert result(spark, "op6", sf_dir) == ordered(want)


def test_op8_base(spark, sf_dir):
    want = []
    for d, t in documents(spark, sf_dir):
        b = base_pii(t or "")
        want.append((d, *(sum(x[1] == k for x in b) for k in range(4)), digest(b, pii.KINDS)))
    assert result(spark, "op8", sf_dir, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == ordered(want)


def test_op8_keeps_base_spans(spark, sf_dir):
    got = {}
    for d, s in result(spark, "op8", sf_dir, "doc_id", "spans"):
        got.setdefault(d, []).append(spans_of(s))
    for d, t in documents(spark, sf_dir):
        base = {(pii.KINDS[k], str(s), str(e)) for s, k, e in base_pii(t or "")}
        assert any(base == {x for x in g if x[0] != "term"} for g in got[d])


def test_op9(spark, sf_dir):
    lower = {i: i + 32 for i in range(65, 91)}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = {}
    for k, t in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect():
        w = split(t)
        if w:  # an item without id hits words, too; only the list cannot name it
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).update([] if k is None else [str(k)])
    sizes = sorted({len(w) for w in windows})
    want = []
    for d, t in documents(spark, sf_dir):
        w = split(t)
        hit, items = np.zeros(len(w), bool), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit[i : i + n] = True
                    items |= own
        want.append((d, len(w), int(hit.sum()), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit.any())))
    assert result(spark, "op9", sf_dir) == ordered(want)


def test_op10(spark, sf_dir):
    want = []
    for d, t in documents(spark, sf_dir):
        w = words(t)
        hit, seen = np.zeros(len(w), bool), {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        for at in seen.values():
            for i in at if len(at) > 1 else ():
                hit[i : i + 3] = True
        lines = [x for x in (t or "").split("\n") if words(x)]
        n, rep = len(w), int(hit.sum())
        want.append((d, n, sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n))
    rows = result(spark, "op10", sf_dir)
    assert ordered(r[:7] for r in rows) == ordered(want)
    assert all(not (r[6] and r[7]) for r in rows)


def test_op10_keeps_good_documents(spark):
    from tests.llm.conftest import SF

    good = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id").collect()}
    bad = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id").collect()}
    rows = {r[0]: r for r in result(spark, "op10", SF)}
    assert all(rows[d][7] for d in good if not rows[d][6])
    assert not any(rows[d][7] for d in bad)


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    df = QUERIES[name](spark, empty_dir)
    assert df.count() == 0 and "void" not in dict(df.dtypes).values()
