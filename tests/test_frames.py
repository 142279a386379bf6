import gzip
import json

import pytest
from pyspark.sql import functions as F

from drainwatch.functions.redact import redact_secrets, redact_url
from drainwatch.plans import dedup
from drainwatch.plans import normalize as nz
from drainwatch.sources import frames as fr
from drainwatch.sources import registry

TX = {"signature": "sig-a", "slot": 777_000_111, "block_time": 1_801_234_567, "tx_index": 41, "ix_index": 5, "inner_ix_index": 0, "indexed_at": 1_801_234_568_250}
CREATE = {**TX, "type": "token_create", "kind": "token", "dex": "pumpfun", "mint": "M", "pool": "P", "base_mint": "M", "quote_mint": "Q", "name": "N", "symbol": "S", "creator": "C"}
LIQ = {**TX, "type": "liquidity", "dex": "d", "pool": "P", "kind": "add", "provider": "C", "base_mint": "M", "quote_mint": "Q", "base_amount": 0, "quote_amount": 12345678901234567890,
       "base_decimals": 6, "quote_decimals": 9, "base_reserve": 36028797018963971, "quote_reserve": 5, "base_usd": "0", "quote_usd": "73.0000000450211"}


def routed(spark, frames):
    rows = [(i, f if isinstance(f, str) else json.dumps(f)) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "id int, value string")


def without(frame, key):
    return {k: v for k, v in frame.items() if k != key}


def test_amounts_past_the_safe_integer_stay_exact(spark):
    row = nz.normalize(nz.frames_to_routed(routed(spark, [LIQ])), "liquidity").first()
    assert (int(row.quote_amount), int(row.base_reserve), str(row.quote_usd)) == (12345678901234567890, 36028797018963971, "73.000000045021100000")


# One kind of damage per kind of field, and texts that are no single object.
DAMAGED = [
    ({**CREATE, "tx_index": 1.5}, "tx_index"), ({**CREATE, "slot": True}, "slot"), ({**CREATE, "signature": 7}, "signature"),
    ({**LIQ, "quote_usd": "12,5"}, "quote_usd"), ({**LIQ, "base_usd": 3}, "base_usd"), ({**LIQ, "quote_amount": "9"}, "quote_amount"), ({**LIQ, "kind": "swap"}, "kind"),
    (without(LIQ, "provider"), "provider"), ({**LIQ, "pool": None}, "pool"), ({**CREATE, "catchup": "yes"}, "catchup"), ({**CREATE, "indexed_at": 1_801_234_568}, "indexed_at"),
    ({**CREATE, "block_time": 1_801_234_567_000}, "block_time"), ({**CREATE, "kind": ["token"]}, "kind"),
]
OTHERS = [
    ("true", "not_an_object"), ("-1.5e3", "not_an_object"), ('[{"type":"swap"}]', "not_an_object"), ('{"type":"Swap"}', "unknown_type"), ('{"type":["swap"]}', "unknown_type"),
    ('{"kind":"token"}', "unknown_type"), ('{"type":"swap"', "invalid_json"), ("{'type':'swap'}", "invalid_json"), (json.dumps(LIQ) + "]", "invalid_json"),
    (json.dumps(LIQ) + " " + json.dumps(LIQ), "invalid_json"),
]


def test_rejections(spark):
    cases = [(f, "invalid_shape", field) for f, field in DAMAGED] + [(f, reason, "") for f, reason in OTHERS]
    rows = nz.validated(nz.frames_to_routed(routed(spark, [f for f, _, _ in cases]))).orderBy("id").collect()
    for row, (frame, reason, field) in zip(rows, cases, strict=True):
        assert row.reason == reason and (not field or any(i.startswith(field + ":") for i in row.issues)), frame


def test_blank_and_missing_texts_are_null_and_extra_fields_are_dropped(spark):
    frames = [{**CREATE, "uri": ""}, {**CREATE, "uri": None}, CREATE, {**CREATE, "uri": "u", "new_field": 1}]
    rows = nz.normalize(nz.frames_to_routed(routed(spark, frames)), "token_create").collect()
    assert [r.uri for r in rows] == [None, None, None, "u"] and "new_field" not in rows[0].asDict()


def test_origin_prefers_catchup(spark):
    frames = [{**CREATE, "backfill": True, "catchup": True}, {**CREATE, "backfill": True}, CREATE]
    rows = nz.normalize(nz.frames_to_routed(routed(spark, frames)), "token_create").collect()
    assert [r.origin for r in rows] == ["catchup", "backfill", "realtime"]


def test_resolver_without_timestamp_and_key_in_the_image_address(spark):
    meta = {"type": "metadata", "mint": "M", "decimals": 6, "image_url": "https://h/i/M?api_key=sk_x", "resolved_at": 9223372036854775807}
    row = nz.normalize(nz.frames_to_routed(routed(spark, [meta])), "metadata").first()
    assert (row.resolved_at_ms, row.image_url, row.socials) == (None, "https://h/i/M", {})


def test_windows_come_in_order_of_seconds(spark):
    w = {"volume_usd": "1.5", "trades": 1, "buys": 1, "sells": 0, "price_change_pct": "0"}
    stats = {"type": "stats", "mint": "M", "price_usd": "1e-9", "block_time": 1790294237, "windows": {"3600": w, "300": w}}
    bad = {**stats, "windows": {"x": w}}
    row = nz.normalize(nz.frames_to_routed(routed(spark, [stats, bad])), "stats").collect()
    assert len(row) == 1 and [x.window_s for x in row[0].windows] == [300, 3600] and float(row[0].price_usd) == 1e-9


def test_a_backfill_copy_has_the_same_key_and_two_sides_of_a_swap_do_not(spark):
    frames = [CREATE, {**CREATE, "backfill": True}, {**CREATE, "mint": "Other"}]
    ev = dedup.dedup_key(nz.normalize(nz.frames_to_routed(routed(spark, frames)), "token_create", ["id"]), "token_create")
    keys = [r.key for r in ev.orderBy("id").collect()]
    assert keys[0] == keys[1] != keys[2]
    assert sorted(r.id for r in dedup.dedup_exact(ev, ["id"]).collect()) == [0, 2]


def test_redaction(spark):
    def one(text, f):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]

    assert one("https://h/x?a=1&api_key=k&b=2#f", redact_url) == "https://h/x?a=1&b=2#f"
    assert one("https://h/x?a=1&api_key=k", redact_url) == "https://h/x?a=1"
    assert one("https://h/x?api_key=k", redact_url) == "https://h/x"
    assert one("https://h/x?my_api_key2=k", redact_url) == "https://h/x?my_api_key2=k"
    assert one('say sk_1 and "u?api_key=abc&z"', lambda c: redact_secrets(c, "sk_1")) == 'say REDACTED and "u?api_key=REDACTED&z"'


def test_scan_reads_plain_and_gzip_and_keeps_unicode_line_ends(spark, tmp_path):
    line = '{"type":"x","name":"a b c"}'
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.jsonl").write_text(line + "\n\n" + line + "\n", encoding="utf-8")
    with gzip.open(tmp_path / "two.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write(line + "\n")
    got = fr.scan_frames(spark, [str(tmp_path), str(tmp_path / "missing")]).select("value").collect()
    assert [r.value for r in got] == [line] * 3
    assert fr.scan_frames(spark, [str(tmp_path / "missing")]).count() == 0


def test_capture_prefix_and_since(spark, tmp_path):
    for name in ("lifecycle-20260926T000000Z-0001", "lifecycle-20260926T120000Z-0002", "lifecycle-20260927T000000Z-0003", "firehose-20260927T000000Z-0001"):
        (tmp_path / f"{name}.jsonl").write_text('{"type":"swap"}\n')
    tiers = fr.scan_capture(spark, str(tmp_path), "20260926").groupBy("tier").count().collect()
    assert {r.tier: r["count"] for r in tiers} == {"lifecycle": 2}
    now = 1790467200 + 3600  # one hour into 2026-09-27
    names = sorted(r.name for r in fr.scan_since(fr.list_files(spark, str(tmp_path)), 6, now).collect())
    assert [n[10:25] for n in names] == ["20260926T120000", "20260927T000000"]
    assert [r.name[10:25] for r in fr.scan_since(fr.list_files(spark, str(tmp_path)), 6, now + 10**7).collect()] == ["20260927T000000"]


def test_prefilter_keeps_a_line_once_however_many_followed_mints_it_names(spark):
    from drainwatch.plans.joins import mint_prefilter

    lines = ['{"base_mint":"A","quote_mint":"B"}', '{"mint":"A"}', '{"mint":"A"}', '{"mint":"Z"}', '{"base_mint":"A","quote_mint":"So11111111111111111111111111111111111111112"}']
    frames = spark.createDataFrame([(x,) for x in lines], "value string")
    mints = spark.createDataFrame([("A",), ("B",)], "mint string")
    assert sorted(r.value for r in mint_prefilter(frames, mints).collect()) == sorted([lines[0], lines[1], lines[2], lines[4]])


def test_a_subset_with_a_key_left_fails(spark):
    frames = spark.createDataFrame([('{"mint":"A","x":"sk_live"}', 5)], "value string, key_s bigint")
    mints = spark.createDataFrame([("A",)], "mint string")
    with pytest.raises(Exception, match="looks|something like a key"):
        fr.extract_subset(frames, mints, 10).collect()


def test_registry_skips_bad_lines_and_old_days(spark, tmp_path):
    now, day = 1790467200, 86400
    recs = spark.createDataFrame([("alert", "red:A", "A", now - day), ("rug", None, "B", now - 30 * day), ("rug", None, "C", now)], "kind string, id string, mint string, t_at bigint")
    path = str(tmp_path / "reg")
    registry.write_registry(recs, path)
    spark.createDataFrame([("{oops", "20260926"), ('{"kind":"other"}', "20260926")], "value string, day string").write.mode("append").partitionBy("day").text(path)
    good, bad = registry.load_registry(spark, path, 7, now)
    assert sorted(r.mint for r in good.collect()) == ["A", "C"] and bad.count() == 2
