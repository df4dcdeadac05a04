"""Deep and broken pages in linear time; shards by target bytes and with equal texts together."""

import time
from collections import defaultdict

import pytest

from terrasphere.llm import kd_shards, main_text


@pytest.mark.parametrize("markup", [
    lambda n: "<div>" * n + "</section>" * n, lambda n: "<div>" * n + "</div></section>" * n, lambda n: "<div>" * n + "<li>x" * n, lambda n: "<div>" * n + "<tr>x" * n])
def test_deep_pages_take_linear_time(markup):
    def seconds(n):
        start = time.process_time()
        page = main_text.Page(markup(n) + "<p>last words", labelled=False)
        assert "last words" in page.text[-1]
        return time.process_time() - start

    seconds(500)
    small, large = min(seconds(2000) for _ in range(3)), min(seconds(16000) for _ in range(2))
    assert large < 24 * small  # eight times the page; a scan of the stack per tag would take sixty-four times as long


def test_stray_and_missing_end_tags():
    def tree(html):
        page = main_text.Page(html, labelled=False)
        return [(t, page.tag[p] if p >= 0 else "") for t, p in zip(page.tag, page.parent)]

    assert tree("<ul><li>a<li>b</ul></li>c") == [("#page", ""), ("ul", "#page"), ("li", "ul"), ("#text", "li"), ("li", "ul"), ("#text", "li"), ("#text", "#page")]
    assert tree("<table><tr><td>a<tr><td>b</table></td>") == [
        ("#page", ""), ("table", "#page"), ("tr", "table"), ("td", "tr"), ("#text", "td"), ("tr", "table"), ("td", "tr"), ("#text", "td")]
    assert tree("</p><p>a<p>b</div>c") == [("#page", ""), ("p", "#page"), ("#text", "p"), ("p", "#page"), ("#text", "p"), ("#text", "p")]


def test_shards_by_target_bytes(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 50 AS int)) || id AS text", "'s' AS source", "'en' AS lang")
    got = kd_shards.shard(docs, target_bytes=10_000).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    total = sum(sizes.values())
    assert len(sizes) == 16 and total / 16 <= 10_000 < total / 8 and max(sizes.values()) < 11_000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kd_shards.shard(docs.where("false"), target_bytes=10).count() == 0
    assert {r.shard for r in kd_shards.shard(docs, target_bytes=10**9).collect()} == {0}


def test_equal_texts_stay_together_but_for_the_cuts(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "'text ' || lpad(CAST(id % 400 AS string), 3, '0') AS text", "'s' AS source", "'en' AS lang")
    homes = defaultdict(set)
    for r in kd_shards.shard(docs).collect():
        homes[r.text_crc32].add(r.shard)
    assert len(homes) == 400 and sum(len(h) > 1 for h in homes.values()) <= 15  # as many as there are cuts
