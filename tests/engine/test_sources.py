"""Readers on small files."""

from tsumugi.sources import dictionary as d

ENTRY = """<?xml version="1.0"?>
<!DOCTYPE JMdict [<!ENTITY n "noun">]>
<JMdict>
<entry><ent_seq>10</ent_seq><k_ele><keb>漢字</keb><ke_pri>ichi1</ke_pri><ke_pri>nf03</ke_pri></k_ele>
<r_ele><reb>おくり</reb><re_inf>&ok;</re_inf></r_ele>
<r_ele><reb>かんじ</reb><re_restr>漢字</re_restr></r_ele><r_ele><reb>カンジ</reb><re_nokanji/></r_ele>
<sense><pos>&n;</pos><pos>&adj-na;</pos><gloss xml:lang="eng">one &amp; two</gloss><gloss>three</gloss></sense>
<sense><misc>&uk;</misc><gloss>four</gloss></sense></entry>
<entry><ent_seq>x1</ent_seq><r_ele><reb>か</reb></r_ele></entry>
<entry><r_ele><reb>き</reb></r_ele></entry>
</JMdict>"""
KANJI = """<kanjidic2><character><literal>亜</literal><radical><rad_value rad_type="classical">7</rad_value></radical><misc><grade>8</grade><stroke_count>7</stroke_count><stroke_count>9</stroke_count><freq>1509</freq></misc>
<reading_meaning><rmgroup><reading r_type="pinyin">ya4</reading><reading r_type="ja_on">ア</reading><reading r_type="ja_kun">つ.ぐ</reading><reading r_type="ja_kun">-め</reading><meaning>Asia</meaning><meaning m_lang="fr">Asie</meaning></rmgroup></reading_meaning></character></kanjidic2>"""


def rows(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


def test_entries(spark, tmp_path):
    path = tmp_path / "dict.xml"
    path.write_text(ENTRY)
    found = d.entries(spark, str(path))
    assert rows(found.select("seq"), "seq") == [(None,), (10,)]
    assert d.broken(spark, str(path)).count() == 1
    own = found.filter("seq = 10")
    assert rows(d.readings(own, "kanji"), "ord") == [(10, 0, "漢字", 3, "[ichi1][nf03]", False)]
    assert rows(d.readings(own, "kana"), "ord") == [(10, 0, "かんじ", None, "", False), (10, 1, "カンジ", None, "", True)]
    assert rows(d.restrictions(own)) == [(10, "かんじ", "漢字")]
    assert rows(d.glosses(own), "sense_ord", "ord") == [(10, 0, 0, "one & two"), (10, 0, 1, "three"), (10, 1, 0, "four")]
    assert rows(d.sense_props(own), "sense_ord", "tag", "ord") == [(10, 0, "pos", 0, "n"), (10, 0, "pos", 1, "adj-na"), (10, 1, "misc", 0, "uk")]
    assert rows(d.entry_counts(own)) == [(10, 1, 2, True)]
    assert d.new_entries(own, own).count() == 1 and d.new_entries(own, own, overwrite=True).count() == 1


def test_kanji(spark, tmp_path):
    path = tmp_path / "kanji.xml"
    path.write_text(KANJI)
    found = d.kanji(spark, str(path))
    assert rows(found.drop("groups")) == [("亜", 7, 1, 8, 7, 1509)]
    assert rows(d.kanji_readings(found).drop("ord"), "type", "text") == [("亜", "ja_kun", "つ", "ぐ", False, False), ("亜", "ja_kun", "め", None, True, False), ("亜", "ja_on", "あ", None, False, False)]
    assert rows(d.kanji_meanings(found)) == [("亜", 0, "Asia")]


def test_places(spark, tmp_path):
    path = tmp_path / "towns.csv"
    path.write_text("1,北海道,,ﾎｯｶｲﾄﾞｳ,\n2,北海道,札幌市,ﾎｯｶｲﾄﾞｳ,ｻｯﾎﾟﾛｼ\n")
    assert rows(d.municipalities(spark, str(path)), "id", "text") == [("1", "北海道", "ほっかいどう", "prefecture", "Hokkaido Prefecture"), ("2", "札幌", "さっぽろ", "city", "Sapporoshi City, Hokkaido Prefecture"), ("2", "札幌市", "さっぽろし", "city", "Sapporoshi City, Hokkaido Prefecture")]
    path = tmp_path / "wards.csv"
    path.write_text("1,札幌市,さっぽろし\n2,札幌市中央区,さっぽろしちゅうおうく\n3,外区,そとく\n")
    assert rows(d.wards(spark, str(path)), "id") == [("2", "中央区", "ちゅうおうく", "札幌"), ("3", "外区", "そとく", "札幌")]


def test_empty(spark, tmp_path):
    path = tmp_path / "none.xml"
    path.write_text("<JMdict></JMdict>")
    found = d.entries(spark, str(path))
    assert d.readings(found, "kana").count() == d.glosses(found).count() == d.entry_counts(found).count() == 0
