"""Grammar of French administrative orders as regular expressions over folded text.

All patterns stay within the syntax shared by Java's engine and linear-time engines (no look-around), so a query and
its SQL check read the same grammar. Folding is one-to-one, so offsets in folded text are offsets in the original.
"""

from __future__ import annotations

# The one-to-one folding of accents, quotes and dashes.
FOLD_FROM = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ’“”«»–—"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy'\"\"\"\"--"

# Months as words, with points, and in three letters.
MONTH_NAMES = ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre")
MONTH_POINTS = ("janv.", "fevr.", "mars", "avr.", "mai", "juin", "juill.", "aout", "sept.", "oct.", "nov.", "dec.")
MONTH_CODES = ("jan", "fev", "mar", "avr", "mai", "jun", "jul", "aou", "sep", "oct", "nov", "dec")
# Ordinals from one to thirteen, and suffixes of ordinal figures.
ORDINALS = {"premier": 1, "deuxieme": 2, "second": 2, "troisieme": 3, "quatrieme": 4, "cinquieme": 5, "sixieme": 6, "septieme": 7, "huitieme": 8, "neuvieme": 9, "dixieme": 10, "onzieme": 11, "douzieme": 12, "treizieme": 13}
EME = "(?:er|eme|e|°|ᵉ)"
ONE_ROMAN = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
ROMANS = {"X" * (n // 10) + ONE_ROMAN[n % 10]: n for n in range(1, 40)}
LONE_V = 22  # a single V is read as a letter, the 22nd of the alphabet


def either(words) -> str:
    """Alternation of literal words."""
    return "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"


MONTH = "(?:" + "|".join(either(m) for m in (MONTH_NAMES, MONTH_POINTS, MONTH_CODES)) + ")"
DATE_WORDS = rf"(?:1er|\d{{1,2}}) {MONTH} (?:\d{{4}}|\d{{2}})"
DATE_FIGURES = r"\d{2}/\d{2}/(?:\d{4}|\d{2})"
DATE = f"(?:{DATE_WORDS}|{DATE_FIGURES})"
AFTER = r"(?:[\s.,);]|$)"
DATED = DATE + AFTER
ORDINAL = either(ORDINALS)
ROMAN = "(?:x{1,3}(?:ix|iv|v?i{0,3})|ix|iv|v?i{1,3})"
NUMBERING = rf"(?:{ROMAN}|[a-z]|\d{{1,2}})"
JOIN = r"(?:\s*(?:,|,?et)\s*)"

# lines
LIST = r"^\s*(?:>|→|-|[a-z1-9][)°])\s+"
IMAGE = r"^!\[[^\[\]]+\]\([^()]+\)"
QUOTE_START = r"^\s*\""
QUOTE_END = r"\"[\s.]*$"
FOOTER = r"^(?:\d+/\d+\s*|page\s+\d+/\d+\s*|page\s+\d+\s+sur\s+\d+\s*|page\s+\d+)"
PAGING = r"\.{5}\s+(?:page\s+)?\d+$"
CONTENTS = rf"^(?:sommaire|table des matieres|liste des (?:chapitres|articles)|.*?\s+{PAGING})"
PUNCTUATION_ONLY = r"^[·.,;:!?'\s-]*$"
# How the elements of an order's header begin, in order of precedence.
HEADERS = {
    "emblem": r"^(?:liberte|egalite|fraternite|republique francaise)",
    "entity": r"^(?:gouvernement|ministeres?|prefecture|sous-prefecture|secretariat|sg|prefete?|academie|rectorat|direction|drire|deal|dreal|service|section|pole|bureau|mission|unite|installations? classees? pour la protection de l'environnement|affaires? suivies? par|cheff?e? de (?:bureau|mission))",
    "identification": r"^(?:ref|n°|n/ref|nor)",
    "arrete_title": r"^\W*arrete(?:nt)?",
    "honorary": r"^(?:l[ea] presidente?|l[ea] ministre|la prefecture|l[ea] prefete?|commissaire|l[ea] rect(?:eur|rice)|recteur|l[ea] direct(?:eur|rice)|commandeur|chevalier|officier|chancelier)",
    "visa": r"^\W*vu(?:\s*:\s*|\b)",
    "motif": r"^\W*considerant(?:\s*:\s*|\b)",
    "supplementary_motif_info": r"^(?:le (?:demandeur|petitionnaire) entendu|l'exploitant entendu|apres communication|sur (?:la )?proposition)",
}
_GAP = r"[.\s:-]"
SECTION_NAMES = "(annexe|titre|chapitre|article)"
TITLE_BARE = rf"^{SECTION_NAMES}{_GAP}*$"
TITLE_NAMED = rf"^{SECTION_NAMES}\s*{_GAP}\s*(?:({ORDINAL})|((?:\d|i)){EME}|({NUMBERING}(?:[.-]\d{{1,2}})*\.?)){_GAP}*(.*)$"
TITLE_DOTTED = rf"^({NUMBERING}(?:[.-]\d{{1,2}})+\.?){_GAP}*(.*)$"
TITLE_PLAIN = rf"^(\d{{1,2}}\.?)\s*{_GAP}\s*(.*)$"
TITLE_ENDING = r"[.;:,]$"

# references
_ID = r"(?:n° ?\S+|\S+[/-]\S+)"
_ACT_DATE = rf"(?:{_ID}\s)?(?:transmis a l'exploitant par (?:courrier recommande|courrier)\s)?(?:(?:du|en date du)\s)?{DATED}"
_ACT_ITEM = rf"(?:(?:{_ID}\s)?(?:(?:du|en date du)\s)?{DATED}|{_ID}(?:\s|$))"
ACTS = rf"arretes (?:(?:prefectoraux|ministeriels) (?:modifies )?)?(?:{_ACT_ITEM}{JOIN}?){{2,}}"
ACT = rf"arrete (?:(?:prefectoral|ministeriel) (?:modifie )?)?(?:(?:complementaire|d'autorisation initiale?|d'autorisation|de mise en demeure|de mesures d'urgence) )?(?:{_ACT_DATE}|{_ID}(?:\s|$))"
ACT_ITEM = _ACT_ITEM
DECREE = rf"decret\s+(?:n\s*°\s*[\d-]+\s+)?du\s+{DATED}"
CIRCULAR = rf"circulaire\s+(?:(?:ministerielle|interministerielle)\s+|[a-z]{{2,}}(?:/[a-z]{{2,}})*\s+)?(?:n\s*°\s*[\d-]+\s+)?du\s+{DATED}"
SELF = "(?:le )?present arrete"
# Domains of European acts, the longest first because the alternation takes the first that fits.
EU_DOMAINS = "(?:ue, euratom|ue|euratom|pesc|cee|cem|ceca|ce|jai)"
EU_TYPES = "(reglement|directive|decision|budget)"
EU_YEAR_FIRST = rf"(?:reglement|directive|decision|budget)\s+(?:europeen(?:ne)?\s+)?(?:n°\s*)?(?:\d{{4}}|\d{{2}})/\d+/{EU_DOMAINS}"
EU_NUM_FIRST = rf"(?:reglement|directive|decision|budget)\s+(?:europeen(?:ne)?\s+)?(?:\({EU_DOMAINS}\)\s*)?(?:n°\s*)?\d+/(?:\d{{4}}|\d{{2}}){AFTER}"
EU = f"(?:{EU_YEAR_FIRST}|{EU_NUM_FIRST})"
CODE_ARTICLE = r"(?:[lrd]\.?\s*(?:\d+\s*-\s*)*\d+)"
DOTTED = r"(?:(?:\d+|[a-z]+)(?:\.(?:\d+|[a-z]+))+\.?)"
SIMPLE = rf"(?:\d+{EME}?)"
ARTICLE_NUMBER = f"(?:{CODE_ARTICLE}|{DOTTED}|{ORDINAL}|{SIMPLE})"
COUNTED = f"(?:{ORDINAL}|{SIMPLE})"
SECTION_LIST = rf"(?:(?:articles? {ARTICLE_NUMBER}(?: a (?:l'article )?{ARTICLE_NUMBER})?(?:{JOIN}{ARTICLE_NUMBER}(?: a (?:l'article )?{ARTICLE_NUMBER})?)+)|(?:alineas? {COUNTED}(?:{JOIN}{COUNTED})+)|(?:paragraphes? {COUNTED}(?:{JOIN}{COUNTED})+))"
SECTION_ONE = rf"(?:articles? {ARTICLE_NUMBER} a (?:l'article )?{ARTICLE_NUMBER}|articles? {ARTICLE_NUMBER}|paragraphes? (?:{CODE_ARTICLE}|{DOTTED})|{COUNTED} alineas?|alineas? {COUNTED}|{COUNTED} paragraphes?|paragraphes? {COUNTED})"
CONNECTOR = r"^(?:\s*[^.\s]+){0,3}\s*(?:du|de\s+l'|de\s+la|des)\s*$"
#: the order in which kinds of references claim text; later ones see only what is left
STAGES = (("acts", ACTS), ("act", ACT), ("decree", DECREE), ("circular", CIRCULAR), ("self", SELF), ("eu", EU), ("sections", SECTION_LIST), ("section", SECTION_ONE))
CLAIMED = "\u0001"

# operations
_THE = r"(?:le|la|les|l')\s"
_OF = r"(?:de|du|des|d')\s"
_TO = r"(?:a|au|a l'|aux)\s"
_COUNT = "(?:un|deux|trois|quatre|cinq|six|sept|huit|neuf|dix)"
_E = "ee?s?"  # participle endings after folding
# Wordings that introduce what replaces a text.
_AS = rf"(?:suivant\sles\sdispositions|par\sles\s(?:suivantes|dispositions|prescriptions)|par\sce\squi\ssuit|comme\sprecise|celles\sdefinies\spar|par\scelles\s(?:inscrites|repertoriees)|ainsi\squ'il\ssuit|dans\sles\sconditions\s(?:suivantes|ci-apres)|ainsi|par\sle\ssuivant|de\sla\s(?:facon|maniere)\ssuivante|comme\ssui(?:t|vant)|comme\s(?:indique|precise|ci-apres)|selon\s{_THE})"
_AUX = r"(?:est\sainsi|sont\sainsi|est|sont)\s"
# Keyword of an amendment and what must follow it, by type, in order of precedence.
OPERATIONS = (
    ("add", f"cre{_E}", rf"\s(?:un\s(?:nouve(?:l|au)\s)?|{_COUNT}\s(?:nouveaux\s)?|en fin\s{_OF}|{_TO}|les dispositions suivantes)"),
    ("add", f"inser{_E}", rf"\s(?:(?:apres|dans)\s{_THE}|(?:au\sdebut|a\sla\sfin|a\sla\ssuite|au\sniveau)\s{_OF}|et\s(?:est|sont)\sainsi\srediges?|le nouve(?:l|au)|les\s{_COUNT}|{_COUNT}\spoints?|{_TO}|les dispositions suivantes)"),
    ("add", f"complet{_E}", r"[,\s]+(?:a\s(?:sa|la)\sfin|comme\ssuit|ainsi|par\s|d')"),
    ("add", rf"(?:modifi{_E}\spar\sl'ajout|ajout{_E})", ""),
    ("replace", rf"(?:modifi{_E}\sou\ssupprim{_E}\set\sremplac{_E}|supprim{_E},\smodifi{_E}\sou\sajout{_E}|modifi{_E},\ssupprim{_E}\sou\scomplet{_E}|modifi{_E},\scomplet{_E},?\sou\sannul{_E}|abrog{_E}\set\ssubstitu{_E}|supprim{_E}\set(?:\sest|\ssont)?\sremplac{_E}|annul{_E}\set\sremplac{_E}|abrog{_E}\s(?:et|ou)\sremplac{_E}|modifi{_E}\set\s(?:remplac|complet){_E}|remplac{_E}\set\scomplet{_E}|modifi{_E}\set\sredig{_E}|modifi{_E}\s(?:et|ou)\ssupprim{_E})", ""),
    ("replace", f"substitu{_E}", r"\spar"),
    ("replace", f"remplac{_E}", rf"\s(?::$|{_AS}|par\s)"),
    ("replace", f"modifi{_E}", rf"\s(?::$|{_AS}|pour\s{_THE}|pour\s(?:ce\s)?qui\sconcerne|par\s:?celles?\s|conformement\s{_TO}|au\sniveau\s{_OF}|de\smaniere\stemporaire)"),
    ("delete", f"(?:abrog{_E}|supprim{_E}|annul{_E})", ""),
)


def operation_pattern(keyword: str, follow: str) -> str:
    """An operation of one kind: everything before is greedy, so the last auxiliary verb counts."""
    return rf"^.*\b{_AUX}({keyword}){follow}"


#: the cheap test before the families: an auxiliary verb and any keyword behind it
ANY_OPERATION = rf"\b{_AUX}(?:{'|'.join(word for _, word, _ in OPERATIONS)})"
INSERTS = next(i for i, (_, word, _) in enumerate(OPERATIONS) if word.startswith("inser"))
#: publication, not insertion
GAZETTE = rf"^.*\b{_AUX}inser{_E}\saux?\srecueils?\sdes\sactes\sadministratifs"
