import duckdb
import pytest
from pyspark.sql import functions as F

from skein.functions import lexical, stems
from skein.operators import search

#: Samples of the published vocabularies, words and stems.
SAMPLES = {
    "english": """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consolation consol consolations consol consolatory consolatori
        console consol consoled consol consolidate consolid consolidated consolid consoling consol consolingly consol consols consol consonant conson consort consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir
        conspire conspir constable constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knag knag knave knave knaves knave knavish knavish kneaded knead knee knee kneel kneel kneeled kneel knell knell knelt knelt
        knick knick knif knif knife knife knight knight knightly knight knit knit knitted knit knives knive knob knob knock knock knocked knock knocker knocker knopp knopp knot knot skies sky dying die news news generate generat generously generous
        communities communiti hopping hop hoping hope happy happi say say by by enjoy enjoy youth youth inning inning innings inning gas gas this this kiwis kiwi ties tie cries cri luxuriated luxuri""",
    "portuguese": """boa boa boainain boainain boas boas boataria boat boate boat boates boat boatos boat bob bob boba bob bobagem bobag bobagens bobagens bobalhões bobalhõ bobear bob bobeira bobeir bobinho bobinh bobo bob bobs bobs boca boc bocadas boc
        bocadinho bocadinh bocado boc bocaiúva bocaiúv boçal boçal bocarra bocarr bode bod bodoque bodoqu boeing boeing boemia boem boêmio boêmi boêmios boêmi quilo quil quilombo quilomb quilométricas quilométr quilômetro quilômetr química químic
        químicas químic quimioterapia quimioterap quimioterápicos quimioteráp quinhão quinhã quinta quint quintana quintan quintanilha quintanilh quintessência quintessent quintuplicou quintuplic quinze quinz quinzena quinzen quiosque quiosqu""",
}
#: What the samples leave out: markers of steps, digits, letters of other scripts, repeated letters, no vowels.
ODD = ["", "a", "ab", "yyy", "ayy", "eyay", "123", "s", "ss", "ies", "abc1ing", "über", "ли", "wwww", "ing", "eed", "feed", "agreed", "rational", "irrational", "vileness", "controlling", "a" * 5000 + "ational",
       "amente", "relativamente", "ativamente", "nervosamente", "publicamente", "habilidade", "atividade", "felicidade", "amavelmente", "constantemente", "nativa", "comia", "peixeira", "segue", "averigue", "face", "nação", "lição", "psicologias"]


@pytest.mark.parametrize("language", SAMPLES)
def test_published_samples_and_sql(spark, language):
    sample = SAMPLES[language].split()
    want = dict(zip(sample[::2], sample[1::2]))
    words = [*want, *ODD]
    got = {r["w"]: r["s"] for r in spark.createDataFrame([(w,) for w in [*words, None]], "w string").select("w", stems.stemmed(F.col("w"), language).alias("s")).collect()}
    assert {w: got[w] for w in want} == want and got[None] is None and got[""] == ""
    values = ", ".join(f"('{w}')" for w in words)
    assert dict(duckdb.sql(stems.stems_sql(f"(VALUES {values}) t(word)", language)).fetchall()) == {w: got[w] for w in words}
    assert stems.stem_of("quilos", "portuguese") == "quil"


def test_a_stem_begins_as_its_word(spark):
    for language, sample in SAMPLES.items():
        words = [*sample.split()[::2], *ODD]
        for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stems.stemmed(F.col("w"), language).alias("s")).collect():
            assert r["w"].startswith(r["s"][: max(1, len(r["s"]) - stems.CHANGED[language])])


def test_search_by_stems(spark):
    rows = spark.createDataFrame([(1, "As químicas quintessências"), (2, "o químico"), (3, "nada"), (4, None), (5, "")], "id long, x string")
    found = lambda q: sorted(r["id"] for r in search.text_topk(rows, F.col("x"), q, 9, "portuguese").collect())
    assert found("química") == [1, 2] and found("quintessência") == [1] and found("as") == []
    assert lexical.websearch("conspiracies -skies", "english") == [[(False, ["conspiraci"])], [(True, ["sky"])]]
