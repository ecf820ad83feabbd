from pyspark.sql import functions as F

from tallyshelf.sources import articles, xml_files


def _item(k, title="", extra=""):
    return (f"<item><title>{title or f'T{k} &amp; <![CDATA[<b>é</b>]]>'}</title><link>https://x/{k}</link><pubDate>Sat, 0{1 + k % 9} Aug 2026 09:00:00</pubDate>"
            f"<description>&lt;p&gt;text {k}&lt;/p&gt;</description>{extra}</item>\n")


def test_one_large_file_in_several_tasks(spark, tmp_path):
    broken = {5: "<item><title>never closed</item>", 700: "<item><title>a & b</title></item>", 1500: "<item><!-- </item> --></item>"}
    text = "<?xml version='1.0'?>\n<rss><channel>" + "".join(broken.get(k) or _item(k) for k in range(2000)) + "<item/></channel></rss>"
    (tmp_path / "one.xml").write_text(text, encoding="utf8")
    conf = {"spark.sql.files.maxPartitionBytes": "50k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        elements = xml_files.read_elements(spark, str(tmp_path), "item")
        assert elements.select(F.spark_partition_id()).distinct().count() > 3
        found, apart = articles.read_rss(spark, str(tmp_path))
        got = [tuple(r) for r in found.orderBy("block", "nth").select("title", "url", "date", "excerpt").collect()]
        assert got == [(f"T{k} & <b>é</b>", f"https://x/{k}", f"2026-08-0{1 + k % 9}", f"text {k}") for k in range(2000) if k not in broken]
        assert apart.columns == ["file", "block", "nth", "element"]
        # The closing tag in the comment cuts its item; what is left of it opens no other.
        assert [r["element"] for r in apart.orderBy("block", "nth").collect()] == [broken[5], broken[700], "<item><!-- </item>"]
        first = articles.read_rss(spark, str(tmp_path), limit=6)[0].orderBy("place").collect()
        assert [(r["place"], r["url"]) for r in first] == [(i + 1, f"https://x/{k}") for i, k in enumerate([0, 1, 2, 3, 4, 6])]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_references_attributes_breaks_and_empty_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss>" + _item(1, "caf&eacute; &amp;amp; &nbsp;x&#233;") + _item(2, "t", '<media:thumbnail url="i.png"/>')
                                    + "<item a='1'><title>u</title><link>v</link></item><item><link>no title</link></item>"
                                    + "<itemised>not one</itemised><item><title>breaks off", encoding="utf8")
    (tmp_path / "b.xml").write_text("", encoding="utf8")
    found, apart = articles.read_rss(spark, str(tmp_path))
    assert [tuple(r) for r in found.orderBy("nth").select("title", "url", "date", "excerpt", "image").collect()] == [
        ("café &amp; \xa0xé", "https://x/1", "2026-08-02", "text 1", ""), ("t", "https://x/2", "2026-08-03", "text 2", "i.png"), ("u", "v", "", "", "")]
    assert [r["element"] for r in apart.collect()] == ["<item><title>breaks off</item>"]
