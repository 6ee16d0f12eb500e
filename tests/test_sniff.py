"""Encodings told apart by what their characters make of the bytes."""

import pytest

from plumbline.sources import sniff

TEXTS = {
    "cp1252": ["name,ville\nHélène Lefèvre,Orléans\nFrançois Gaëtan,Besançon\nZoé Noël,Évreux\n", "name;ort\nJürgen Groß;Köln\nMünchen für Käthe;Düsseldorf\n", "nombre,ciudad\nMuñoz Peña,Cádiz\nJosé Ramírez,León\n", "navn,by\nSøren Ærø,Århus\n"],
    "cp1250": ["imię,miasto\nŁukasz Wiśniewski,Łódź\nMałgorzata Wójcik,Gdańsk\nPaweł Dąbrowski,Rzeszów\n", "jméno,město\nJiří Dvořák,Plzeň\nTomáš Růžička,České Budějovice\n", "név,város\nSzűcs Gergő,Győr\nŐrsi Bálint,Hódmezővásárhely\n"],
    "cp1251": ["имя,город\nИван Петров,Москва\nОльга Сидорова,Нижний Новгород\n"],
    "koi8-r": ["имя,город\nИван Петров,Москва\nОльга Сидорова,Нижний Новгород\n"],
    "cp1253": ["όνομα,πόλη\nΓιώργος Παπαδόπουλος,Θεσσαλονίκη\n"],
    "shift_jis": ["名前,都市\n山田太郎,とうきょう\nさとうはなこ,オオサカ\n"],
    "euc_jp": ["名前,都市\n山田太郎,とうきょう\nさとうはなこ,オオサカ\n"],
    "utf-16-le": ["name,city\nAnn,Rome\nBé,Nice\n", "имя,город\nИван,Москва\n"],
    "utf-16-be": ["name,city\nAnn,Rome\n"],
    "utf-8": ["name,city\nplain,text\n", "имя,город\nИван,Москва\n", "名前,都市\n山田,とうきょう\n"],
}


@pytest.mark.parametrize(("name", "text"), [(n, t) for n, ts in TEXTS.items() for t in ts])
def test_encoding(name, text):
    got = sniff.encoding_of(text.encode(name))
    assert text.encode(name).decode(got) == text


def test_marks_and_cut_samples():
    assert sniff.encoding_of("a,b\n".encode("utf-16")) == "utf-16" and sniff.encoding_of(b"\xef\xbb\xbfa") == "utf-8-sig"
    long = ("é" * 10 + ",b\n") * 4000
    assert sniff.encoding_of(long.encode()[: sniff.SAMPLE_BYTES]) == "utf-8"
