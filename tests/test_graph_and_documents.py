"""Evidence graph, text repair, canonical documents, sanitised data and stores, against plain loops and known cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import documents, photo_graph, repair, sanitise
from plumbline.sources import files
from plumbline.sources.keyed_store import AssetVault, KeyedStore, listed

PHOTO = "session string, at int, photo long, text string, user_text string, labels array<struct<label:string,confidence:double>>, states array<string>, parts array<string>"


def photos(spark, rows):
    """Rows of ``(session, at, text, user text, label, confidence, states)``."""
    full = [(s, at, k, text, user, [(label, sure)] if label else [], states, [label] if label else []) for k, (s, at, text, user, label, sure, states) in enumerate(rows)]
    return photo_graph.photo_evidence(spark.createDataFrame(full, PHOTO))


def test_photos_of_one_and_another_object(spark):
    rows = [
        ("one", 0, "BRAND ACME MODEL MX-100", "这台机器", "device", 0.92, []), ("one", 1, "MODEL: MX-100 SERIAL: SN001", "这是背面的铭牌", "device", 0.92, []),
        ("conflict", 0, "MODEL: MX-100", None, "device", 0.92, []), ("conflict", 1, "MODEL: ZX-900", None, "device", 0.92, []),
        ("said", 0, "MODEL: MX-100", None, "device", 0.92, []), ("said", 1, "MODEL: MX-100", "这是另外一台机器", "device", 0.92, []),
        ("panel", 0, "MODEL: MX-100", "整机", "device", 0.92, []), ("panel", 1, "ERROR E12", "这是这台设备的控制面板", "device", 0.92, ["red_indicator"]),
        ("weak", 0, "MODEL: MX-100", None, "device", 0.92, []), ("weak", 1, None, "", "unknown-object", 0.55, []),
    ]
    evidence = photos(spark, rows)
    placed = {r.photo: r for r in photo_graph.placed_photos(evidence).collect()}
    assert [placed[k].status for k in range(10)] == ["new_object", "same_object", "new_object", "likely_new_object", "new_object", "likely_new_object", "new_object", "probably_same_object", "new_object", "likely_new_object"]
    assert placed[1].entity == 0 and placed[3].entity == 3 and placed[5].entity == 5 and placed[7].entity == 6
    summary = {r.entity: r for r in photo_graph.entity_summary(evidence, photo_graph.placed_photos(evidence)).collect()}
    assert (summary[6].model, summary[6].photos, summary[6].error_codes, summary[6].states, summary[6].views) == ("MX-100", 2, ["E12"], ["red_indicator"], ["nameplate", "display"])
    assert (summary[0].serial, summary[0].views) == ("SN001", ["nameplate"])


def slow_places(rows):
    """One session photo by photo, one object by one."""
    objects, out = [], []
    for photo, row in rows:
        status, found = "new_object", None
        if objects and row["another"]:
            status = "likely_new_object"
        elif objects:
            scored = []
            for e in objects:
                score, hard = 0.18, False
                for field, gain in (("serial", 0.75), ("model", 0.48)):
                    if e[field] and row[field]:
                        if photo_graph.plain(e[field]) == photo_graph.plain(row[field]):
                            score += gain
                        else:
                            hard, score = True, 0.0 if field == "serial" else min(score, 0.05)
                if e["brand"] and row["brand"]:
                    score += 0.18 if photo_graph.plain(e["brand"]) == photo_graph.plain(row["brand"]) else -0.2
                hits = [x for x in row["labels"] if photo_graph.plain(x["label"]) in e["labels"]]
                score += min(0.28, hits[0]["confidence"] * 0.25) if hits else 0
                scored.append((max(0.0, min(1.0, score + (0.22 if row["same"] else 0))), hard, e))
            scored.sort(key=lambda x: -x[0])
            (top, hard, e), rival = scored[0], scored[1][0] if len(scored) > 1 else 0
            if hard:
                status = "likely_new_object"
            elif top >= 0.82 and (top - rival >= 0.15 or len(objects) == 1):
                status, found = "same_object", e
            elif top >= 0.58:
                status, found = "probably_same_object", e
            else:
                status = "likely_new_object" if top <= 0.22 else "unresolved"
        if found is None:
            found = {"id": photo, "serial": None, "model": None, "brand": None, "labels": set()}
            objects.append(found)
        for field in ("serial", "model", "brand"):
            found[field] = found[field] or row[field]
        found["labels"] |= {photo_graph.plain(x["label"]) for x in row["labels"]}
        out.append((photo, found["id"], status))
    return out


def test_places_equal_a_sequential_loop_in_a_hot_session(spark):
    rng = random.Random(3)
    made = []
    for k in range(900):
        text = "\n".join(x for x in (f"Model: MX-{rng.randrange(40)}" if rng.random() < 0.5 else "", f"Serial: SER{rng.randrange(90)}" if rng.random() < 0.3 else "", f"Brand: {rng.choice(['Acme', 'ACME', 'Bolt'])}" if rng.random() < 0.5 else ""))
        made.append(("hot" if rng.random() < 0.6 else f"s{rng.randrange(80)}", rng.randrange(500), text, rng.choice([None, None, "same", "a different machine"]), rng.choice(["pump", "fan", None]), rng.random(), []))
    evidence = photos(spark, made).cache()
    rows = sorted((r.asDict(recursive=True) for r in evidence.collect()), key=lambda r: (r["session"], r["at"], r["photo"]))
    want = []
    for session in {r["session"] for r in rows}:
        want += slow_places([(r["photo"], r) for r in rows if r["session"] == session])
    assert sorted((r.photo, r.entity, r.status) for r in photo_graph.placed_photos(evidence).collect()) == sorted(want)
    assert photo_graph.placed_photos(evidence.limit(0)).count() == 0


REPAIRS = [
    ("T O T A L 656.38\nPRODUCTO TOTALMENTE NUEVO", "TOTAL 656.38\nPRODUCTO TOTALMENTE NUEVO", ["JOIN_TOTAL_LABEL"]),
    ("T0TAL 656.38\n1VA 8.87\nCAMB10 43.62\nEFECT1V0 700.00", "TOTAL 656.38\nIVA 8.87\nCAMBIO 43.62\nEFECTIVO 700.00", ["LABEL_O0_TOTAL", "LABEL_IL1_IVA", "LABEL_IL10_CAMBIO", "LABEL_IL10_EFECTIVO"]),
    ("OXXO\nTOTAL $7O.OO\nFOLIO OIIO", "OXXO\nTOTAL $70.00\nFOLIO OIIO", ["AMOUNT_GLYPH_OIL_TO_01"]),
    ("SUB\nTOTAL 100.00\nIVA 8.00\nTOTAL 108.00", "SUBTOTAL 100.00\nIVA 8.00\nTOTAL 108.00", ["JOIN_SUBTOTAL_LABEL"]),
    ("EL FLORIDO\nEL FLORIDO\nIVA 8.00\nIVA 8.00\nTOTAL 16.00", "EL FLORIDO\nIVA 8.00\nIVA 8.00\nTOTAL 16.00", ["ADJACENT_DUPLICATE_NONFINANCIAL_LINE"]),
    ("EL FLORIDO\nSUBT0TAL 647.51\n1VA 8% 8.87\nT0TAL $656.38\nEFECT1V0 7O0.00\nCAMB10 43.62", "EL FLORIDO\nSUBTOTAL 647.51\nIVA 8% 8.87\nTOTAL $656.38\nEFECTIVO 700.00\nCAMBIO 43.62", None),
    ("EFECT1V0 700.00\nCAMB10 43.62", "EFECTIVO 700.00\nCAMBIO 43.62", ["LABEL_IL10_CAMBIO", "LABEL_IL10_EFECTIVO"]),
    ("ＴＯＴＡＬ　９．５０\r\n​", "TOTAL 9.50", ["UNICODE_WHITESPACE_NORMALIZATION"]),
    ("a\n\n a\nb", "a\na\nb", []),
    ("", "", []), (None, "", []),
]


def test_repairs_and_their_log(spark):
    df = spark.createDataFrame([(k, t, "kept") for k, (t, *_) in enumerate(REPAIRS)], "id int, text string, log string")
    got = {r.id: r for r in repair.repaired(df.drop("log")).collect()}
    for k, (_, want, rules) in enumerate(REPAIRS):
        assert got[k].normalized == want
        assert rules is None or [e.rule for e in got[k].log] == rules
        assert got[k].confidence == min([e.confidence for e in got[k].log], default=1.0)
        assert got[k].changed == (want != (REPAIRS[k][0] or "").strip())
    glyph = got[2].log[0]
    assert (glyph.before, glyph.after) == ("$7O.OO", "$70.00")


def nested(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, 2.5, "x", "it's", True, None, "é", -7, ""])
    if rng.random() < 0.4:
        return [nested(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {rng.choice(["a", "b.c", "d'e", "z", "é"]): nested(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_canonical_text_and_leaves(spark):
    rng = random.Random(2)
    trees = [{"t": nested(rng, 5)} for _ in range(60)]
    shuffled = lambda v: {k: shuffled(v[k]) for k in sorted(v, key=lambda _: rng.random())} if isinstance(v, dict) else [shuffled(x) for x in v] if isinstance(v, list) else v
    rows = [(k, json.dumps(t, ensure_ascii=False), json.dumps(shuffled(t), indent=1)) for k, t in enumerate(trees)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    for r in df.select("id", documents.canonical(F.col("a")).alias("a"), documents.canonical(F.col("b")).alias("b")).collect():
        assert r.a == r.b == json.dumps(trees[r.id], sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def leaves(v, path="$"):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from leaves(x, f"{path}.{k}")
        elif isinstance(v, list):
            for k, x in enumerate(v):
                yield from leaves(x, f"{path}[{k}]")
        else:
            yield path, v if isinstance(v, str) else json.dumps(v)

    want = sorted((k, *leaf) for k, t in enumerate(trees) for leaf in leaves(t))
    assert sorted(tuple(r) for r in documents.leaves(df, ["id"], "a").collect()) == want
    assert documents.leaves(spark.createDataFrame([(1, "{broken"), (2, None)], "id int, a string"), ["id"], "a").count() == 0


def test_manifests_find_one_altered_leaf(spark):
    rows = [("d", f"c{k}", json.dumps({"caseId": f"c{k}", "difficulty": "easy" if k else "hard", "f": {"n": k}})) for k in range(5)] + [("e", "c0", '{"caseId":"c0"}')]
    cases = spark.createDataFrame(rows, "dataset string, case string, doc string")
    made = documents.manifests(cases, "dataset", "case", "doc", ["difficulty"])
    got = {r.dataset: r for r in made.collect()}
    assert (got["d"].cases, got["d"].difficulty, got["e"].difficulty) == (5, "easy=4,hard=1", "undefined=1")
    import hashlib

    text = json.dumps([json.loads(r[2]) for r in rows[:5]], sort_keys=True, separators=(",", ":"))
    assert got["d"].content_hash == "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    changed = cases.withColumn("doc", F.when(F.col("case") == "c3", F.replace("doc", F.lit('"n": 3'), F.lit('"n": 4'))).otherwise(F.col("doc")))
    assert {r.dataset: r.hash_matches for r in documents.verified(made, changed, "dataset", "case", "doc").collect()} == {"d": False, "e": True}
    assert [tuple(r) for r in documents.altered(cases, changed, ["dataset", "case"], "doc").collect()] == [("d", "c3", "$.f.n", "3", "4")]


def test_sanitiser_keeps_no_secret(spark, tmp_path):
    data = {"providerId": "teacher-a", "apiKey": "SECRET", "rawText": "private receipt", "answer": "private answer", "media": [{"dataUrl": "data:image/jpeg;base64,SECRETIMAGE"}], "score": 0.91, "many": list(range(70)), "extra": {"sessionToken": "SECRET2", "userQuestion": "private 😀", "plain": "kept"}}
    schema = "data struct<providerId:string,apiKey:string,rawText:string,answer:string,media:array<struct<dataUrl:string>>,score:double,many:array<int>,extra:map<string,string>>"
    df = spark.createDataFrame([(data,)], schema)
    kind = df.schema["data"].dataType
    row = df.select(sanitise.sanitised(F.col("data"), kind).alias("data")).first().data
    text = str(row)
    assert not any(x in text for x in ("SECRET", "private"))
    assert row.providerId.value == "teacher-a" and row.score == 0.91 and row.apiKey.redacted and len(row.many) == 50
    assert row.extra["plain"].value == "kept" and row.extra["sessionToken"].kind == "sensitive_field" and row.extra["userQuestion"].length == 10
    h = 2166136261
    for unit in memoryview("private 😀".encode("utf-16-le")).cast("H"):
        h = (h ^ unit) * 16777619 & 0xFFFFFFFF
    assert row.extra["userQuestion"].hash == f"{h:08x}"
    assert spark.createDataFrame([(None,)], schema).select(sanitise.sanitised(F.col("data"), kind).alias("data")).first().data is None
    log = df.select(F.lit("e1").alias("id"), F.lit("noted").alias("type"), F.lit(3).alias("at"), F.lit("x").alias("execution"), F.lit("t").alias("task"), "data")
    files.append_log(log, str(tmp_path / "log"))
    files.append_log(log.withColumn("id", F.lit("e2")).withColumn("execution", F.lit("y")).withColumn("at", F.lit(4)), str(tmp_path / "log"))
    assert "teacher-a" not in str(files.read_log(spark, str(tmp_path / "log")).collect())
    assert [r.id for r in files.read_log(spark, str(tmp_path / "log"), execution="y").collect()] == ["e2"]
    assert [r.id for r in files.read_log(spark, str(tmp_path / "log"), task="t", last=1).collect()] == ["e2"]
    files.retain_log(spark, str(tmp_path / "log"), str(tmp_path / "kept"), 1)
    assert files.read_log(spark, str(tmp_path / "kept")).count() == 2


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_store_saves_removes_and_survives_a_broken_compaction(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"))
    with pytest.raises(LookupError):
        store.list()
    frame = lambda rows: spark.createDataFrame(rows, "key string, state string, n int")
    store.save(frame([("a", "new", 1), ("b", "new", 2), ("b", "done", 1), ("c", None, None)]), "n")
    store.remove(frame([("a", "", 0), ("zz", "", 0)]))
    store.save(frame([("d", "new", 4)]))
    want = [("b", "new", 2), ("c", None, None), ("d", "new", 4)]
    assert sorted(map(str, rows_of(store.list()))) == sorted(map(str, want))
    staged, upto = store.staged_base()  # a compaction that dies here has published nothing
    again = KeyedStore(spark, str(tmp_path / "s"))
    assert sorted(map(str, rows_of(again.list()))) == sorted(map(str, want)) and again._live()[0] == 0
    assert again.compact() and not again.compact() and upto == again._live()[0]
    assert not again.versions.publish(staged, "base", upto)  # the slower of two compactions changes nothing
    again.save(frame([("a", "back", 9)]))
    again.remove(frame([("d", "", 0)]))
    assert again.compact()
    again.vacuum()
    assert rows_of(again.list().filter("n > 0")) == [("a", "back", 9), ("b", "new", 2)]
    assert again.load(frame([("b", "", 0), ("d", "", 0)])).count() == 1
    assert rows_of(again.list(state="back", n=None)) == [("a", "back", 9)]


def test_lists_by_tags(spark):
    df = spark.createDataFrame([(1, "t", ["x", "y"]), (2, "t", ["x"]), (3, "u", None)], "id int, task string, tags array<string>")
    assert {r.id for r in listed(df).collect()} == {1, 2, 3}
    assert {r.id for r in listed(df, task="t", tags=["x"]).collect()} == {1, 2}
    assert {r.id for r in listed(df, tags=["y", "x"]).collect()} == {1}


def test_vault_keeps_contents_once_until_no_name_is_left(spark, tmp_path):
    vault = AssetVault(spark, str(tmp_path / "v"))
    frame = lambda rows: spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary")
    vault.put(frame([("a", b"one"), ("b", b"one"), ("c", b"three")]))
    vault.put(frame([("d", b"one"), ("c", b"four!")]))
    assert tuple(vault.stats().first()) == (4, 14, 2, 8, 3)
    vault.remove(frame([("a", b""), ("b", b"")]))
    vault.collect_garbage()
    assert tuple(vault.stats().first()) == (2, 8, 2, 8, 2)
    vault.remove(frame([("d", b"")]))
    vault.collect_garbage()
    vault.put(frame([("e", b"three")]))
    assert sorted((r.name, bytes(r.content)) for r in vault.resolve(frame([("c", b""), ("d", b""), ("e", b"")])).collect()) == [("c", b"four!"), ("e", b"three")]
    assert tuple(vault.stats().first())[-1] == 2
