"""Stemmers of ten more languages, after the published Snowball definitions.

A word's regions: R1 follows the first non-vowel after a vowel, R2 is R1 of R1,
RV is a region of the verb that each language family defines. A step finds the
longest of its endings and then tests the conditions of that one only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable


def _ending(word: str, endings: Iterable[str], start: int = 0) -> str | None:
    """The longest of ``endings`` that ``word`` ends with, from ``start`` on."""
    rest = word[start:]
    return max((e for e in endings if rest.endswith(e)), key=len, default=None)


def _after(word: str, vowels: str, start: int = 0) -> int:
    """The end of the first non-vowel that follows a vowel, from ``start``."""
    found = re.compile(f"[{vowels}][^{vowels}]").search(word, start)
    return found.end() if found else len(word)


def _regions(word: str, vowels: str, least: int = 0) -> tuple[int, int]:
    """The starts of R1, after ``least`` letters or more, and R2."""
    one = _after(word, vowels)
    return max(one, min(least, len(word))), _after(word, vowels, one)


def _romance_rv(word: str, vowels: str) -> int:
    """The start of RV in Spanish, Portuguese and Italian."""
    if len(word) < 3:
        return len(word)
    if word[1] not in vowels:
        found = re.compile(f"[{vowels}]").search(word, 2)
    elif word[0] in vowels:
        found = re.compile(f"[^{vowels}]").search(word, 2)
    else:
        return 3
    return found.end() if found else len(word)


def _cut(word: str, ending: str, put: str = "") -> str:
    return word[: len(word) - len(ending)] + put


def _cut_in(word: str, start: int, endings: Iterable[str]) -> str:
    """``word`` without the longest of ``endings``, if that lies from ``start`` on."""
    found = _ending(word, endings)
    return _cut(word, found) if found and len(word) - len(found) >= start else word


# -- Scandinavian languages: fixed values of the algorithms

SWEDISH_ENDINGS = """a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas
    ornas es ades andes ens arens hetens erns at andet het ast s""".split()
DANISH_ENDINGS = """hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes
    eres ens hedens erens ers ets erets et eret s""".split()
NORWEGIAN_ENDINGS = """a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets
    et het ast s erte ert""".split()


def swedish(word: str) -> str:
    r1, _ = _regions(word, "aeiouyäåö", 3)
    found = _ending(word, SWEDISH_ENDINGS, r1)
    if found and (found != "s" or word[-2:-1] in tuple("bcdfghjklmnoprtvy")):
        word = _cut(word, found)
    if _ending(word, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        word = word[:-1]
    found = _ending(word, ("lig", "ig", "els", "löst", "fullt"), r1)
    return word[:-1] if found in ("löst", "fullt") else _cut(word, found or "")


def danish(word: str) -> str:
    vowels = "aeiouyæåø"
    r1, _ = _regions(word, vowels, 3)

    def pair(word: str) -> str:
        return word[:-1] if _ending(word, ("gd", "dt", "gt", "kt"), r1) else word

    found = _ending(word, DANISH_ENDINGS, r1)
    if found and (found != "s" or word[-2:-1] in tuple("abcdfghjklmnoprtvyzå")):
        word = _cut(word, found)
    word = pair(word)
    if word.endswith("igst"):
        word = word[:-2]
    found = _ending(word, ("ig", "lig", "elig", "els", "løst"), r1)
    if found:
        word = word[:-1] if found == "løst" else pair(_cut(word, found))
    if len(word) > r1 and word[-1] not in vowels and word[-2:-1] == word[-1]:
        word = word[:-1]
    return word


def norwegian(word: str) -> str:
    vowels = "aeiouyæåø"
    r1, _ = _regions(word, vowels, 3)
    found = _ending(word, NORWEGIAN_ENDINGS, r1)
    if found in ("erte", "ert"):
        word = _cut(word, found, "er")
    elif found == "s":
        if word[-2:-1] in tuple("bcdfghjlmnoprtvyz") or (word[-2:-1] == "k" and word[-3:-2] and word[-3] not in vowels):
            word = word[:-1]
    elif found:
        word = _cut(word, found)
    if _ending(word, ("dt", "vt"), r1):
        word = word[:-1]
    return _cut(word, _ending(word, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"), r1) or "")


# -- German and Dutch


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    word = word.replace("ß", "ss")
    word = re.sub(f"(?<=[{vowels}])([uy])(?=[{vowels}])", lambda m: m[1].upper(), word)
    r1, r2 = _regions(word, vowels, 3)

    def within(start: int, ending: str) -> bool:
        return word.endswith(ending) and len(word) - len(ending) >= start

    found = _ending(word, ("em", "ern", "er", "e", "en", "es", "s"))
    if found and within(r1, found) and (found != "s" or word[-2:-1] in tuple("bdfghklmnrt")):
        word = _cut(word, found)
        if found in ("e", "en", "es") and word.endswith("niss"):
            word = word[:-1]
    found = _ending(word, ("en", "er", "est", "st"))
    if found and within(r1, found) and (found != "st" or (len(word) >= 6 and word[-3] in "bdfghklmnt")):
        word = _cut(word, found)
    found = _ending(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if found and within(r2, found):
        before = _cut(word, found)
        if found in ("end", "ung"):
            word = before
            if within(r2, "ig") and not word.endswith("eig"):
                word = word[:-2]
        elif found in ("ig", "ik", "isch"):
            word = word if before.endswith("e") else before
        elif found in ("lich", "heit"):
            word = before
            if within(r1, "er") or within(r1, "en"):
                word = word[:-2]
        else:
            word = before
            more = _ending(word, ("lich", "ig"))
            if more and within(r2, more):
                word = _cut(word, more)
    return word.lower().translate(str.maketrans("äöü", "aou"))


def dutch(word: str) -> str:
    vowels = "aeiouyè"
    word = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    word = re.sub(f"^y|(?<=[{vowels}])y", "Y", word)
    word = re.sub(f"(?<=[{vowels}])i(?=[{vowels}])", "I", word)
    r1, r2 = _regions(word, vowels, 3)

    def within(start: int, ending: str) -> bool:
        return word.endswith(ending) and len(word) - len(ending) >= start

    def single(word: str) -> str:
        return word[:-1] if word.endswith(("kk", "dd", "tt")) else word

    def without_en(word: str, ending: str) -> str:
        before = _cut(word, ending)
        return single(before) if len(before) >= r1 and before and before[-1] not in vowels and not before.endswith("gem") else word

    def without_e(word: str) -> str:
        return single(word[:-1]) if word.endswith("e") and len(word) - 1 >= r1 and len(word) > 1 and word[-2] not in vowels else word

    found = _ending(word, ("heden", "en", "ene", "s", "se"))
    if found == "heden":
        word = _cut(word, found, "heid") if within(r1, found) else word
    elif found in ("en", "ene"):
        word = without_en(word, found)
    elif found:
        before = _cut(word, found)
        word = before if len(before) >= r1 and before and before[-1] not in vowels + "j" else word
    shorter = without_e(word)
    had_e, word = shorter != word, shorter
    if within(r2, "heid") and not word.endswith("cheid"):
        word = word[:-4]
        if word.endswith("en"):
            word = without_en(word, "en")
    found = _ending(word, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if found and within(r2, found):
        before = _cut(word, found)
        if found in ("end", "ing"):
            word = before
            word = word[:-2] if within(r2, "ig") and not word.endswith("eig") else single(word)
        elif found == "ig":
            word = word if before.endswith("e") else before
        elif found == "lijk":
            word = without_e(before)
        elif found == "baar" or had_e:
            word = before
    if re.search(f"[^{vowels}](aa|ee|oo|uu)[^{vowels}I]$", word):
        word = word[:-2] + word[-1]
    return word.lower()


# -- Russian: fixed values of the algorithm; endings of a first kind follow а or я

GERUND_1, GERUND_2 = "в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE_1, PARTICIPLE_2 = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
VERB_1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
VERB_2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(word: str) -> str:
    vowels = "аеиоуыэюя"
    word = word.replace("ё", "е")
    found = re.search(f"[{vowels}]", word)
    if found is None:
        return word
    rv, (_, r2) = found.end(), _regions(word, vowels)

    def kinds(word: str, first: list[str], second: list[str]) -> str:
        found = _ending(word, first + second, rv)
        if not found or (found in first and (len(word) - len(found) <= rv or word[-len(found) - 1] not in "ая")):
            return word
        return _cut(word, found)

    done = kinds(word, GERUND_1, GERUND_2)
    if done == word:
        word = _cut(word, _ending(word, ("ся", "сь"), rv) or "")
        adjective = _ending(word, ADJECTIVE, rv)
        if adjective:
            done = kinds(_cut(word, adjective), PARTICIPLE_1, PARTICIPLE_2)
        else:
            done = kinds(word, VERB_1, VERB_2)
            if done == word:
                done = _cut(word, _ending(word, NOUN, rv) or "")
    word = done
    word = _cut(word, _ending(word, ("и",), rv) or "")
    word = _cut(word, _ending(word, ("ост", "ость"), max(rv, r2)) or "")
    found = _ending(word, ("нн", "н", "ейш", "ейше", "ь"), rv)
    if found in ("ейш", "ейше"):
        word = _cut(word, found)
        found = _ending(word, ("нн",), rv)
    return word[:-1] if found in ("нн", "ь") else word


# -- Spanish, Portuguese and Italian: fixed values of the algorithms

SPANISH_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
SPANISH_PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
SPANISH_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
SPANISH_PUT = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
SPANISH_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
SPANISH_U = "en es éis emos".split()
SPANISH_VERBS = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos
    eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste
    iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses
    ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split()
PORTUGUESE_PLAIN = """eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos
    adora ador aça~o adoras adores aço~es ante antes ância""".split()
PORTUGUESE_PUT = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
PORTUGUESE_VERBS = """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam
    eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas
    idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes
    istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos
    íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos
    irmos eu iu ou ira iras""".split()
ITALIAN_PRONOUNS = """ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele
    teli telo tene cela cele celi celo cene vela vele veli velo vene""".split()
ITALIAN_PLAIN = """anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa
    ose mente atrice atrici ante anti""".split()
ITALIAN_IC = "azione azioni atore atori".split()
ITALIAN_PUT = {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
ITALIAN_VERBS = """ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi
    endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi
    evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci
    isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir""".split()


def _chain(word: str, r2: int, first: str, then: str, others: tuple[str, ...] = ()) -> str:
    """Without ``first`` and, before it, ``then``; without one of ``others`` where the word does not end in ``first``."""
    if word.endswith(first):
        shorter = _cut_in(word, r2, (first,))
        return _cut_in(shorter, r2, (then,)) if shorter != word else word
    return _cut_in(word, r2, others)


def spanish(word: str) -> str:
    vowels, plain = "aeiouáéíóúü", str.maketrans("áéíóú", "aeiou")
    rv, (r1, r2) = _romance_rv(word, vowels), _regions(word, vowels)
    pronoun = _ending(word, SPANISH_PRONOUNS)
    if pronoun:
        stem = _cut(word, pronoun)
        before = _ending(stem, ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if before and len(stem) - len(before) >= rv and (before != "yendo" or stem.endswith("uyendo")):
            word = _cut(stem, before, before.translate(plain))
    began = word
    endings = [*SPANISH_PLAIN, *SPANISH_IC, *SPANISH_PUT, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
    found = _ending(word, endings)
    if found and len(word) - len(found) >= (r1 if found == "amente" else r2):
        word = _cut(word, found, SPANISH_PUT.get(found, ""))
        if found in SPANISH_IC:
            word = _cut_in(word, r2, ("ic",))
        elif found == "amente":
            word = _chain(word, r2, "iv", "at", ("os", "ic", "ad"))
        elif found == "mente":
            word = _cut_in(word, r2, ("ante", "able", "ible"))
        elif found in ("idad", "idades"):
            word = _cut_in(word, r2, ("abil", "ic", "iv"))
        elif found.startswith("iv"):
            word = _cut_in(word, r2, ("at",))
    if word == began:
        found = _ending(word, SPANISH_Y, rv)
        if found and _cut(word, found).endswith("u"):
            word = _cut(word, found)
        else:
            found = _ending(word, SPANISH_U + SPANISH_VERBS, rv)
            word = _cut(word, found or "")
            if found in SPANISH_U and word.endswith("gu"):
                word = word[:-1]
    found = _ending(word, ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if found and len(word) - len(found) >= rv:
        word = _cut(word, found)
        if found in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(plain)


def portuguese(word: str) -> str:
    vowels = "aeiouáéíóúâêô"
    word = word.replace("ã", "a~").replace("õ", "o~")
    rv, (r1, r2) = _romance_rv(word, vowels), _regions(word, vowels)
    began = word
    endings = [*PORTUGUESE_PLAIN, *PORTUGUESE_PUT, "amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras"]
    found = _ending(word, endings)
    if found in ("ira", "iras"):
        word = _cut(word, found, "ir") if len(word) - len(found) >= rv and _cut(word, found).endswith("e") else word
    elif found and len(word) - len(found) >= (r1 if found == "amente" else r2):
        word = _cut(word, found, PORTUGUESE_PUT.get(found, ""))
        if found == "amente":
            word = _chain(word, r2, "iv", "at", ("os", "ic", "ad"))
        elif found == "mente":
            word = _cut_in(word, r2, ("ante", "avel", "ível"))
        elif found in ("idade", "idades"):
            word = _cut_in(word, r2, ("abil", "ic", "iv"))
        elif found.startswith("iv"):
            word = _cut_in(word, r2, ("at",))
    if word == began:
        word = _cut(word, _ending(word, PORTUGUESE_VERBS, rv) or "")
    if word != began:
        if word.endswith("ci") and len(word) - 1 >= rv:
            word = word[:-1]
    else:
        word = _cut_in(word, rv, ("os", "a", "i", "o", "á", "í", "ó"))
    if word.endswith(("e", "é", "ê")):
        if len(word) - 1 >= rv:
            word = word[:-1]
            if word.endswith(("gu", "ci")) and len(word) - 1 >= rv:
                word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


def italian(word: str) -> str:
    vowels = "aeiouàèìòù"
    word = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    word = re.sub(f"(?<=[{vowels}])([iu])(?=[{vowels}])", lambda m: m[1].upper(), word)
    rv, (r1, r2) = _romance_rv(word, vowels), _regions(word, vowels)
    pronoun = _ending(word, ITALIAN_PRONOUNS)
    if pronoun:
        stem = _cut(word, pronoun)
        before = _ending(stem, ("ando", "endo", "ar", "er", "ir"))
        if before and len(stem) - len(before) >= rv:
            word = stem if len(before) > 2 else stem + "e"
    began = word
    endings = [*ITALIAN_PLAIN, *ITALIAN_IC, *ITALIAN_PUT, "amento", "amenti", "imento", "imenti", "amente", "ità", "ivo", "ivi", "iva", "ive"]
    found = _ending(word, endings)
    if found and len(word) - len(found) >= (rv if found in ("amento", "amenti", "imento", "imenti") else r1 if found == "amente" else r2):
        word = _cut(word, found, ITALIAN_PUT.get(found, ""))
        if found in ITALIAN_IC:
            word = _cut_in(word, r2, ("ic",))
        elif found == "amente":
            word = _chain(word, r2, "iv", "at", ("os", "ic", "abil"))
        elif found == "ità":
            word = _cut_in(word, r2, ("abil", "ic", "iv"))
        elif found in ("ivo", "ivi", "iva", "ive"):
            word = _chain(word, r2, "at", "ic")
    if word == began:
        word = _cut(word, _ending(word, ITALIAN_VERBS, rv) or "")
    if word[-1:] in tuple("aeioàèìò") and len(word) - 1 >= rv:
        word = word[:-1]
        if word.endswith("i") and len(word) - 1 >= rv:
            word = word[:-1]
    if word.endswith(("ch", "gh")) and len(word) - 2 >= rv:
        word = word[:-1]
    return word.lower()


# -- French: fixed values of the algorithm

FRENCH_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FRENCH_IC = "atrice ateur ation atrices ateurs ations".split()
FRENCH_PUT = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FRENCH_OTHER = """ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments""".split()
FRENCH_I = """îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais
    issait issant issante issantes issants isse issent isses issez issiez issions issons it""".split()
FRENCH_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
FRENCH_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(word: str) -> str:
    vowels = "aeiouyâàëéêèïîôûù"
    word = word.replace("qu", "qU")
    word = re.sub(f"(?<=[{vowels}])([ui])(?=[{vowels}])", lambda m: m[1].upper(), word)
    word = re.sub(f"(?<=[{vowels}])y|y(?=[{vowels}])", "Y", word)
    r1, r2 = _regions(word, vowels)
    if len(word) >= 3 and (word.startswith(("par", "col", "tap")) or (word[0] in vowels and word[1] in vowels)):
        rv = 3
    else:
        found = re.compile(f"[{vowels}]").search(word, 1)
        rv = found.end() if found else len(word)
    began, adverb = word, False

    def within(start: int, ending: str) -> bool:
        return word.endswith(ending) and len(word) - len(ending) >= start

    def else_put(ending: str, put: str) -> str:
        """Without an ending in R2, with ``put`` in its place elsewhere."""
        return _cut(word, ending, "" if within(r2, ending) else put)

    found = _ending(word, [*FRENCH_PLAIN, *FRENCH_IC, *FRENCH_PUT, *FRENCH_OTHER])
    before = _cut(word, found or "")
    if found in ("ement", "ements"):
        if within(rv, found):
            word = before
            more = _ending(word, ("iv", "eus", "abl", "iqU", "ièr", "Ièr"))
            if more == "iv":
                word = _chain(word, r2, "iv", "at")
            elif more == "eus":
                word = _cut(word, more) if within(r2, more) else _cut(word, more, "eux") if within(r1, more) else word
            elif more in ("abl", "iqU"):
                word = _cut_in(word, r2, (more,))
            elif more and within(rv, more):
                word = _cut(word, more, "i")
    elif found in ("eaux", "aux"):
        word = word[:-1] if found == "eaux" else before + "al" if within(r1, found) else word
    elif found in ("euse", "euses"):
        word = before if within(r2, found) else before + "eux" if within(r1, found) else word
    elif found in ("issement", "issements"):
        word = before if within(r1, found) and before and before[-1] not in vowels else word
    elif found in ("amment", "emment"):
        if within(rv, found):
            word, adverb = before + ("ant" if found == "amment" else "ent"), True
    elif found in ("ment", "ments"):
        if len(before) > rv and before[-1] in vowels:
            word, adverb = before, True
    elif found and within(r2, found):
        word = before + FRENCH_PUT.get(found, "")
        if found in FRENCH_IC and word.endswith("ic"):
            word = else_put("ic", "iqU")
        elif found in ("ité", "ités"):
            more = _ending(word, ("abil", "ic", "iv"))
            word = else_put(more, {"abil": "abl", "ic": "iqU", "iv": "iv"}[more]) if more else word
        elif found in ("if", "ive", "ifs", "ives") and within(r2, "at"):
            word = word[:-2]
            word = else_put("ic", "iqU") if word.endswith("ic") else word
    if word == began or adverb:
        held = word
        found = _ending(word, FRENCH_I, rv)
        if found and len(word) - len(found) > rv and word[-len(found) - 1] not in vowels:
            word = _cut(word, found)
        else:
            found = _ending(word, ["ions", *FRENCH_E, *FRENCH_A], rv)
            if found == "ions":
                word = _cut_in(word, r2, (found,))
            elif found:
                word = _cut(word, found)
                if found in FRENCH_A and within(rv, "e"):
                    word = word[:-1]
        changed = word != held or adverb
    else:
        changed = True
    if changed:
        word = word[:-1] + {"Y": "i", "ç": "c"}.get(word[-1:], word[-1:])
    else:
        if word.endswith("s") and word[-2:-1] not in tuple("aiouès"):
            word = word[:-1]
        found = _ending(word, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), rv)
        if found == "ion":
            word = _cut(word, found) if within(r2, found) and len(word) - 3 > rv and word[-4] in "st" else word
        elif found in ("e", "ë"):
            word = _cut(word, found) if found == "e" or word.endswith("guë") else word
        elif found:
            word = _cut(word, found, "i")
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    return re.sub(f"[éè]([^{vowels}]+)$", r"e\1", word).lower()


STEMMERS: dict[str, Callable[[str], str]] = {
    "danish": danish, "dutch": dutch, "french": french, "german": german, "italian": italian, "norwegian": norwegian, "portuguese": portuguese, "russian": russian, "spanish": spanish, "swedish": swedish,
}
