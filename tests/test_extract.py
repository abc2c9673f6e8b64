"""Captured documents to items."""

from datetime import datetime

from pyspark.sql import functions as F

from murmur.operators import burst, extract
from murmur.sources import markup

MARKED = """<html><body>
<div data-post-item="m1" data-post-author="alpha" data-post-display-name="A &amp; co"
 data-post-posted-at="2026-08-04T09:12:04Z"> A <b>red</b>
 kite<br> was seen. </div>
<div data-post-item="m2" data-post-author="beta" data-post-posted-at="2026-08-04T09:12:19Z">წითელი ფრანი</div>
<p>outside</p>
<div data-post-item="" data-post-author="x" data-post-posted-at="2026-08-04T09:12:31Z">no id</div>
<div data-post-item="m4" data-post-author="d" data-post-posted-at="yesterday">bad time</div>
<div data-post-item="m5" data-post-author="e" data-post-posted-at="2026-08-04">123</div>
<div data-post-item="open" data-post-author="f" data-post-posted-at="2026-08-04">never closed
"""

CHANNEL = """<div class="hist">
<div class="tgme_widget_message js" data-post="kites/1"><div>
 <a class="tgme_widget_message_owner_name"><span>Kite
   Log</span></a>
 <div class="tgme_widget_message_text">one <b>bold</b> line<br>two</div>
 <time datetime="2026-08-04T09:12:04+00:00">09:12</time><time datetime="1999-01-01">x</time>
</div></div>
<div class="tgme_widget_message" data-post="gusts/2">
 <div class="tgme_widget_message_text">no time</div></div>
<div class="tgme_widget_message">no id</div></div>"""


def captures(spark, *rows):
    return spark.createDataFrame(
        [("t", "s", f"c{i}", "tr", platform, body if isinstance(body, bytes) else body.encode())
         for i, (platform, body) in enumerate(rows)],
        "tenant_id string, source_id string, capture_id string, trace_id string, "
        "platform string, body binary",
    )


def test_marked_page(spark):
    shaped = extract.extract(captures(spark, ("canary", MARKED))).orderBy("ordinal").collect()
    good = [r for r in shaped if r.problem is None]
    assert [r.external_id for r in good] == ["m1", "m2", "m5"]
    assert good[0].text == "A red kite was seen."
    assert good[0].author_display_name == "A & co"
    assert good[1].author_display_name is None
    assert [r.script for r in good] == ["latin", "georgian", None]
    assert [r.timestamp_precision for r in good] == ["second", "second", "day"]
    assert len(shaped) - len(good) == 2


def test_channel_page(spark):
    shaped = extract.extract(captures(spark, ("telegram", CHANNEL))).orderBy("ordinal").collect()
    assert [r.external_id for r in shaped] == ["kites/1", "gusts/2"]
    first = shaped[0]
    assert first.author_handle == "kites"
    assert first.author_display_name == "Kite\n Log"
    assert first.text == "one bold linetwo"
    assert first.posted_at == datetime(2026, 8, 4, 9, 12, 4)
    assert "unreadable time" in shaped[1].problem


def test_unknown_platform_uses_the_marker_reader(spark):
    rows = extract.extract(captures(spark, ("something", MARKED)))
    assert extract.accepted(rows).count() == 3


def test_normalised_json(spark):
    good = (
        '{"posts":[{"external_id":"1","page_handle":"p","page_name":"P","text":"x",'
        '"posted_at_raw":"2026-08-04T09:12:04+0000","permalink":""},7,{"external_id":5}],'
        '"schema":"posts.v1"}'
    )
    bad = ['not json', '[]', '{"schema":"other","posts":[{}]}', '{"schema":"posts.v1","posts":3}']
    shaped = extract.extract(captures(spark, ("facebook", good), *[("facebook", b) for b in bad]))
    rows = shaped.orderBy("ordinal").collect()
    assert [(r.capture_id, r.external_id, r.problem is None) for r in rows] == [
        ("c0", "1", True), ("c0", "5", False),
    ]


def test_capture_validation(spark):
    frame = captures(spark, ("canary", MARKED), ("canary", "<html></html>"))
    runs = extract.validate_captures(frame, extract.extract(frame), extract.CAPTURE_KEYS)
    rows = {r.capture_id: r for r in runs.collect()}
    assert (rows["c0"]["items"], rows["c0"].rejected, rows["c0"].validation_passed) == (3, 2, False)
    assert (rows["c1"]["items"], rows["c1"].validation_passed) == (0, False)


def test_invalid_bytes_are_replaced(spark):
    broken = MARKED.encode().replace(b"seen", b"s\xffen")
    rows = extract.accepted(extract.extract(captures(spark, ("canary", broken)))).orderBy("ordinal")
    assert "s�en" in rows.first().text


def test_golden_channels_make_one_burst(spark):
    """Four channels inside 41 seconds and one eleven minutes later."""
    times = ["09:12:04", "09:12:17", "09:12:31", "09:12:45", "09:23:40"]
    page = "".join(
        f'<div class="tgme_widget_message" data-post="ch{i}/{i}">'
        f'<div class="tgme_widget_message_text">same</div>'
        f'<time datetime="2026-08-04T{t}+00:00"></time></div>'
        for i, t in enumerate(times)
    )
    items = extract.content_rows(extract.extract(captures(spark, ("telegram", page))))
    obs = items.withColumn("project_id", F.lit("p"))
    (found,) = burst.detect(obs).collect()
    assert (found.item_count, found.account_count) == (4, 4)


def test_documents_are_stable(spark):
    posts = spark.createDataFrame(
        [("k", 2, "b"), ("k", 1, "a"), ("k", 3, "ხ")], "k string, ordinal long, text string"
    ).selectExpr(
        "k", "ordinal", "text as external_id", "'h' as page_handle", "'n' as page_name", "text",
        "'2026' as posted_at_raw", "'' as permalink",
    )
    a = markup.posts_to_documents(posts, ["k"]).first().body
    b = markup.posts_to_documents(posts.orderBy(F.desc("ordinal")), ["k"]).first().body
    assert a == b
    assert a.startswith('{"posts":[{"external_id":"a","page_handle":"h"')
