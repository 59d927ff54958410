"""Words and stems of the sample vocabularies that are published with the definitions."""

import pytest

from folioflow.functions.snowball import stem_french, stem_german, stem_spanish
from folioflow.functions.stemming import STEMMERS

GERMAN = """
aufeinander aufeinand aufeinanderbiss aufeinanderbiss aufeinanderfolge aufeinanderfolg aufeinanderfolgen aufeinanderfolg
aufeinanderfolgend aufeinanderfolg aufeinanderfolgende aufeinanderfolg aufenthalt aufenthalt aufenthalten aufenthalt
aufenthaltes aufenthalt auferlegen auferleg auferlegt auferlegt auferlegten auferlegt auferstand auferstand auferstanden auferstand
auferstehen aufersteh aufersteht aufersteht auferstehung aufersteh kategorie kategori kategorien kategori kategorisch kategor
kategorische kategor kater kat katers kat kätzchen katzch kaufen kauf käufer kauf kaufmann kaufmann kaum kaum
käuflich kauflich straße strass häuser haus freundlichkeit freundlich bedürfnisse bedurfnis
"""

FRENCH = """
continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu
continuel continuel continuelle continuel continuellement continuel continuelles continuel continuels continuel continuer continu
continuera continu continuerait continu continueront continu continuez continu continuité continu continuons continuon
contorsions contors contour contour contournait contourn contournant contourn contourne contourn contours contour
contractait contract contracté contract contractée contract contracter contract contractés contract contractions contract
contradictoirement contradictoir contradictoires contradictoir contraindre contraindr contraint contraint contrainte contraint
contraire contrair contraires contrair contraria contrari main main mains main maintenaient mainten maintenait mainten
maintenant mainten maintenir mainten maintenue maintenu maintien maintien maintint maintint maire mair maires mair mairie mair
mais mais maison maison maisons maison maistre maistr maître maîtr maîtresse maîtress majesté majest majestueuse majestu
majestueusement majestu majestueux majestu majeur majeur majeure majeur major major majordome majordom majorité major
majorités major mal mal malacca malacc malade malad malades malad maladie malad maladies malad maladive malad
"""

SPANISH = """
cheque chequ chequeo cheque cheques chequ cheyenne cheyenn chi chi chía chi chiapaneca chiapanec chiapas chiap chica chic
chicago chicag chicano chican chicanos chican chicas chic chicharrones chicharron chichén chichen chichimecas chichimec
chicles chicl chico chic torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor
torearlo tor toreo tore torero torer toreros torer torio tori tormenta torment tormentas torment tornado torn tornados torn
tornar torn tornen torn torneo torne torneos torne tornillo tornill torno torn toro tor toronto toront toros tor
torpedearon torped torpeza torpez torrado torr torralba torralb torre torr torrencial torrencial torrenciales torrencial
torrente torrent torreon torreon torreón torreon torres torr torrescano torrescan
"""


def pairs(text):
    words = text.split()
    return list(zip(words[::2], words[1::2], strict=True))


@pytest.mark.parametrize("stem,vocabulary", [(stem_german, GERMAN), (stem_french, FRENCH), (stem_spanish, SPANISH)])
def test_published_words(stem, vocabulary):
    assert [(w, stem(w)) for w, _ in pairs(vocabulary)] == pairs(vocabulary)


@pytest.mark.parametrize("code", sorted(STEMMERS))
def test_any_word_has_a_stem(code):
    for word in ("", "a", "y", "ss", "st", "e", "é", "qu", "ment", "amment", "os", "gu", "guë", "uy", "日本", "x1_2", "aaaa", "eaux", "yendo", "heit", "ung"):
        assert isinstance(STEMMERS[code](word), str)
