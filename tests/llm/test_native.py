"""Exact dedup, sharding and personal data: brute force, edge cases, and no Python on the executors."""

import hashlib
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from copse.llm import dedup, pii, sharding

ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "x" * 200_000), (6, "c"), (7, "c"), (7, "c"), (None, "c"), (None, "only"), (9, "a b ")]


def _expected(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {t: (best((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("weak", [False, True])
def test_dedup_report(docs, keep, best, weak):
    options = {"digest": lambda t: F.lit(b"same")} if weak else {}
    got = dedup.dedup_report(docs(ROWS), keep=keep, **options).collect()
    want = _expected(ROWS, best)
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(want)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_hash[r["text_sha256"]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]


@pytest.mark.parametrize("weak", [False, True])
def test_drop_copies(docs, weak):
    options = {"digest": lambda t: F.lit(b"same")} if weak else {}
    df = docs(ROWS)
    got = dedup.drop_copies(df, keep="largest", **options)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got.collect()) == sorted((i or -1, t) for t, (i, _) in _expected(ROWS, max).items())
    assert dedup.drop_copies(docs([]), **options).isEmpty() and dedup.dedup_report(docs([])).isEmpty()


def _shard(doc_id, topology):
    def draw(name, weight):
        h = 42 if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed=42)
        import math

        return -math.log(((xxhash.xxh64_intdigest(name.encode(), seed=h) >> 12) + 0.5) / 2**52) / weight

    weight = lambda x: x if isinstance(x, float) else sum(map(weight, x.values()))
    racks = topology.regions[min(topology.regions, key=lambda r: draw(r, weight(topology.regions[r])))]
    shards = racks[min(racks, key=lambda r: draw(r, weight(racks[r])))]
    return min(shards, key=lambda s: draw(f"shard{s}", shards[s]))


def test_shards_by_brute_force_and_laws(docs):
    rows = [(i, f"text {i}") for i in range(600)] + [(5, "text 5"), (None, None), (7, "")]
    tree = sharding.Topology.regular(40)
    got = sharding.assign_shards(docs(rows), tree).collect()
    assert len(got) == len(rows)
    slots = {}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
    for r in got:
        assert r["shard"] == _shard(r["doc_id"], tree) and r["grown_shard"] == _shard(r["doc_id"], tree.grow())
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        assert (r["size"], r["text_crc32"]) in texts[r["doc_id"]]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(docs([]), tree).isEmpty()


def test_reweighting_moves_only_in_changed_subtrees(docs):
    tree = sharding.Topology.regular(40)
    lighter = tree.reweighted(3, 0.5)
    for i in range(400):
        a, b = _shard(i, tree), _shard(i, lighter)
        assert a == b or a // 10 == 0  # only documents of the region whose weight fell may move


_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
    return total % 10 == 0


def _base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(_BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


PII = [
    None, "", "mail me: a.b+c@x-y.co.uk, or é日 z@q.r_x@d.e", "10.0.0.1 1.2.3.4.5 256.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 1 23 4111111111111111",
    "+49 (0)30 1234567 +1-800 +123456789012345678", "IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, not GB82WEST12345698765433", "9" * 60_000, "a" * 60_000 + "@b.c", "1.2." * 5000, "+1 " * 5000 + "@" * 1000,
]


def test_pii_against_brute_force(docs):
    got = {r["doc_id"]: r for r in pii.pii_report(docs(list(enumerate(PII)))).collect()}
    for i, t in enumerate(PII):
        base = _base_spans(t or "")
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (i, r["spans"], base)
        assert [r[f"n_{k}"] for k in _BASE] == [sum(b.startswith(k + ":") for b in base) for k in _BASE]
    extra = [s for s in got[6]["spans"].split(",") if s.startswith("iban")]
    assert extra == ["iban:5:32", "iban:36:58"]
    assert pii.pii_report(docs([])).isEmpty()


HEX = "f32ab9ba2834a0d390df92664b1272635dbc0ec6"
ADDED = {
    "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": ["iban:5:32:0.90"],
    "pay GB82WEST12345698765432 2024 or NO9386011117947 7": ["iban:4:26:0.60", "iban:35:50:0.60"],
    "XDE89370400440532013000 DE89370400440532013000X ZZ89370400440532013000 _DE89370400440532013000": [],
    f'token = "{HEX}" and {"word " * 9}{HEX}': ["secret:9:49:0.70"],
    f"commit {HEX}": [],
    f"API_KEY:{HEX.upper()}": ["secret:8:48:0.70"],
    f"key {HEX}{HEX}": [],
    "key " + "1" * 40 + " key " + "a" * 40: [],
    f"étoken {HEX}": ["secret:7:47:0.70"],
    "secret " + "a1" * 30_000: [],
}


def test_added_spans_need_length_checksum_or_context(docs, spark):
    import duckdb

    from copse.llm import queries

    rows = list(enumerate([*ADDED, *PII, "Mail: a@b.c, x@y.z " + "w" * 40 + " q@r.s"]))
    got = sorted(pii.pii_report(docs(rows)).collect())
    for r, want in zip(got, ADDED.values(), strict=False):
        assert [f"{a}:{b}" for a, b in zip(r["spans"].split(","), r["scores"].split(","), strict=True) if a] == want
    with duckdb.connect() as db:
        documents = docs(rows).select("doc_id", "text").toPandas()  # noqa: F841, read by the SQL
        sql = db.sql(f"SELECT * FROM ({queries.oracle_sql()['op7_pii_spans']}) ORDER BY doc_id")
        assert sql.columns == pii.pii_report(docs(rows)).columns
        assert [tuple(r) for r in got] == sql.fetchall()


def test_pii_scores_and_redaction(docs):
    df = docs([(1, "call +49 30 12345678 now"), (2, "xx +49 30 12345678 now"), (3, None)])
    scores = {r["doc_id"]: r["pii"] for r in pii.find_spans(df).select("doc_id", "pii").collect()}
    assert scores[1][0]["score"] > scores[2][0]["score"] and scores[3] == []
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == ["call <PHONE> now", "xx <PHONE> now", None]


def test_native_plans_have_no_python(docs):
    for df in (pii.pii_report(docs(ROWS)), dedup.dedup_report(docs(ROWS)), sharding.assign_shards(docs(ROWS), sharding.Topology.regular(8))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
