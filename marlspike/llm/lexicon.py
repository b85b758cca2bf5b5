"""Script and function-word evidence for the languages of short texts."""

from __future__ import annotations

import re

# Frequent words that tell the Latin-script languages apart.
WORDS = {
    "en": "the and of a in from on to for with at my it by before after not that is each you over if but which was when file order can so week please near be your am how like were this should we do i are will new any me what why loan would he she they them their our us stop only who says than nothing often same bill since around where there has had have did does about because until through more less some other no yes hello hi thanks thank you're don't can't won't isn't sorry help need want give send cancel refund late slow again good morning evening ok okay order's just also its into out up off then else give agent person someone somebody speak talk call get got let see very much many who whom tell ask say said make made take took come came going went could can't cannot must might every never always only still already today tomorrow yesterday working works".split(),
    "fr": "le la les et de des du une un pour avant reçu d'aide à vous par puis depuis au aux chez ce cette vérifier commande jours pouvez avec merci carte essayez je j'ai me mon ma mes pas ne n'est n'ai n'arrive est sont suis été et ou où qui que quand comment combien pourquoi votre vos nous ici moins fois avoir être l'application l'erreur l'agence colis facture forfait numéro souhaite voudrais impossible bonjour merci svp s'il plaît aucun aucune personne toujours encore déjà répond quelle quel c'est d'un d'une il elle on sur dans sans vers sous entre mais donc car si très trop peu beaucoup virement reste bloqué dossier".split(),
    "tl": "ang ng sa na po at mag para ninyo mula ako kayo kayong ko mo ito iyon hindi pa pero bago noong ay mga kay kapag kung dahil paki pakitingnan tingnan nag nagpadala naglipat nais kong gusto palitan ilipat walang wala may maaari maaaring puwedeng pumunta tulong makita numero resibo tayo siya sila kami namin natin nila niya lang din rin naman opo oo salamat kumusta magandang araw ano anong bakit saan nasaan kailan paano pakibuksan buksan makapasok ayaw sobrang bagal signal dito doon ngayon beses tumawag sumasagot dapat gawin nakabinbin habang nagbabayad aking akong iyan".split(),
    "arabizi": "el fi men ma w 3ala ma3 gabl 3end 7ag raqm bas laish leish hatha hathi hay hni 6alab chi mal abi abgha shu shno aish yani wayed kil li elli ela la2ni 3an ghair marra marrat nafs badal zyada mob mab mo enta enti ana ani inta int e7na hom shlon shloon keef kaif wain wein mta meta sar 9ar ba3ad al7een le7een lain ila ya allah salam marhaba shukran mashkoor mashkooreen khabrooni fahmooni sawait asawi ygool galoo galo raddkum a7taj dafa3t 7awalt wasal wasalni kartti fatorti raqmi malaf baqat mablagh jihaz bdoon khasm rosoom yom gool esmi emaili 3nwani ismi abi abgy la na3am tayeb zain bukra ams youm shay hal lazem".split(),
}
SETS = {k: frozenset(v) for k, v in WORDS.items()}
#: Words that two of the lists share tell nothing.
SHARED = frozenset(w for a in SETS for b in SETS if a < b for w in SETS[a] & SETS[b])
KNOWN = {k: (v - SHARED).__contains__ for k, v in SETS.items()}

LATIN_TOKEN = re.compile(r"[a-z0-9à-ɏ]+(?:['’][a-z0-9à-ɏ]+)*'?")
ARABIC_TOKEN = re.compile("[\u0621-\u065f\u066e-\u06d3\u06fa-\u06ff\ufb50-\ufefc]+")
#: A word with a letter of Urdu that Arabic lacks.
URDU_TOKEN = re.compile("[\u0621-\u065f\u066e-\u06d3]*[ٹڈڑںےہھگچپیکۓ][\u0621-\u065f\u066e-\u06d3]*")
#: A Latin word with digits for Arabic sounds; measures, ordinals and codes are none.
DIGIT_WORD = re.compile(r"(?=[a-z0-9']*[a-z])(?:[a-z']*[a-z']?[2356789][a-z'][a-z0-9']*|[a-z'][a-z']*[2356789][a-z0-9']*)")
MEASURE = re.compile(r"\d+(?:gb|mb|am|pm|k|st|nd|rd|th|x|h|min|kg|g|m|km|fa|d|s|b|w|z)")


def evidence(text: str) -> dict[str, int]:
    """Words of ``text`` that speak for each language; Arabic-script words count whole, Latin ones if listed."""
    out: dict[str, int] = {}
    low = text.lower()
    latin = LATIN_TOKEN.findall(low)
    if latin:
        for k, known in KNOWN.items():
            n = sum(map(known, latin))
            if n:
                out[k] = n
        n = sum(1 for w in latin if not w.isalpha() and not w.isdigit() and DIGIT_WORD.fullmatch(w) and not MEASURE.fullmatch(w))
        if n:
            out["arabizi"] = out.get("arabizi", 0) + n
    if not text.isascii() and (n := len(ARABIC_TOKEN.findall(text))):
        ur = len(URDU_TOKEN.findall(text))
        # Arabic words without Urdu letters occur in Urdu (names), hardly the other way
        if ur >= 0.25 * n:
            out["ur"] = n
        else:
            out["ar"] = n
            if ur >= 4:
                out["ur"] = ur
    return out


def languages(text: str, least: int = 2) -> dict[str, int]:
    """Languages of a text with their evidence in words; those under ``least`` and a tenth of the best drop out."""
    out = evidence(text)
    best = max(out.values(), default=0)
    return {k: v for k, v in out.items() if v >= min(least, best) and v >= 0.1 * best}
