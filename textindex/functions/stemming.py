"""C4: the Snowball stemmers (English Porter2, Spanish) as chained SQL projections.

Written from the published algorithm descriptions as lists of steps. A step is a
set of named SQL expressions over the columns of the step before; ``w`` is the word
so far, and regions are kept as the lengths before them. The same steps are
rendered for Spark and, for the oracle, for DuckDB, whose spellings differ only in
the few functions of ``Dialect``. Words of two characters or fewer are returned
unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str

    def like(self, text: str, pattern: str) -> str:
        fn = "regexp_like" if self.name == "spark" else "regexp_matches"
        return f"{fn}({text}, '{pattern}')"

    def replace_all(self, text: str, pattern: str, group_then: str) -> str:
        """Every match by its first group and a text."""
        if self.name == "spark":
            return f"regexp_replace({text}, '{pattern}', '$1{group_then}')"
        return f"regexp_replace({text}, '{pattern}', '\\1{group_then}', 'g')"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


def _suffix(text: str, suffixes: Iterable[str]) -> str:
    """The longest of the suffixes that ``text`` ends in, or ''."""
    return f"regexp_extract({text}, '({'|'.join(suffixes)})$', 1)"


def _cut(text: str, suffix: str) -> str:
    return f"left({text}, length({text}) - length({suffix}))"


def _case(subject: str, values: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"CASE {subject} {whens} ELSE {otherwise} END"


def _in(values: Iterable[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _after_vowel_consonant(text: str, before: str, vowels: str, d: Dialect) -> str:
    """Length up to and with the first consonant after a vowel, beyond ``before``."""
    pattern = f"^[^{vowels}]*[{vowels}]+[^{vowels}]"
    return (f"{before} + CASE WHEN {d.like(text, pattern)} "
            f"THEN length(regexp_extract({text}, '({pattern})', 1)) ELSE length({text}) END")


# -- English -----------------------------------------------------------------

_EN = "aeiouy"

# Fixed values of the published algorithm: whole-word exceptions.
EN_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlantic": "atlantic",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EN_LATER_EXCEPTIONS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")

# Fixed values of the published algorithm: suffixes of steps 2, 3 and 4.
EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
EN_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
EN_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
            "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _short(text: str, d: Dialect) -> str:
    """Whether ``text`` ends in a short syllable."""
    return (f"({d.like(text, f'[^{_EN}][{_EN}][^{_EN}wxY]$')} "
            f"OR {d.like(text, f'^[{_EN}][^{_EN}]$')})")


def english_steps(d: Dialect) -> list[dict[str, str]]:
    def kept(done: str, step: str) -> str:
        return f"CASE WHEN {done} THEN w ELSE {step} END"

    base = "base"
    fixed = (f"CASE WHEN {d.like(base, '(at|bl|iz)$')} THEN base || 'e' "
             f"WHEN {d.like(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN left(base, length(base) - 1) "
             f"WHEN length(base) = r1 AND {_short(base, d)} THEN base || 'e' ELSE base END")
    step2 = _case("e", {k: f"base || '{v}'" for k, v in EN_STEP2.items() if k not in ("ogi", "li")}
                  | {"ogi": f"CASE WHEN {d.like(base, 'l$')} THEN base || 'og' ELSE w END",
                     "li": f"CASE WHEN {d.like(base, '[cdeghkmnrt]$')} THEN base ELSE w END"}, "w")
    step3 = _case("e", {k: f"base || '{v}'" for k, v in EN_STEP3.items() if k != "ative"}
                  | {"ative": "CASE WHEN length(base) >= r2 THEN base ELSE w END"}, "w")
    return [
        {"w": d.replace_all("regexp_replace(term, '^y', 'Y')", f"([{_EN}])y", "Y"),
         "done": f"length(term) <= 2 OR term IN {_in(EN_EXCEPTIONS)}"},
        {"r1": f"CASE WHEN {d.like('w', '^(gener|commun|arsen)')} "
               f"THEN length(regexp_extract(w, '^(gener|commun|arsen)', 1)) "
               f"ELSE {_after_vowel_consonant('w', '0', _EN, d)} END"},
        {"r2": _after_vowel_consonant("substr(w, r1 + 1)", "r1", _EN, d)},
        {"w": kept("done", f"CASE WHEN {d.like('w', 'sses$')} THEN left(w, length(w) - 2) "
                           f"WHEN {d.like('w', '(ied|ies)$')} THEN left(w, length(w) - 3) "
                           f"|| CASE WHEN length(w) > 4 THEN 'i' ELSE 'ie' END "
                           f"WHEN {d.like('w', '(us|ss)$')} THEN w "
                           f"WHEN {d.like('w', f'[{_EN}].+s$')} THEN left(w, length(w) - 1) ELSE w END")},
        {"done": f"done OR w IN {_in(EN_LATER_EXCEPTIONS)}",
         "e": _suffix("w", ("eedly", "ingly", "edly", "eed", "ing", "ed"))},
        {"base": _cut("w", "e")},
        {"w": kept("done", f"CASE WHEN e IN ('eed', 'eedly') THEN "
                           f"CASE WHEN length(base) >= r1 THEN base || 'ee' ELSE w END "
                           f"WHEN e <> '' AND {d.like(base, f'[{_EN}]')} THEN {fixed} ELSE w END")},
        {"w": kept("done", f"CASE WHEN {d.like('w', f'.[^{_EN}][yY]$')} "
                           f"THEN left(w, length(w) - 1) || 'i' ELSE w END")},
        {"e": _suffix("w", EN_STEP2)}, {"base": _cut("w", "e")},
        {"w": kept("done OR length(base) < r1", step2)},
        {"e": _suffix("w", EN_STEP3)}, {"base": _cut("w", "e")},
        {"w": kept("done OR length(base) < r1", step3)},
        {"e": _suffix("w", EN_STEP4)}, {"base": _cut("w", "e")},
        {"w": kept("done OR length(base) < r2",
                   f"CASE WHEN e = 'ion' AND NOT {d.like(base, '[st]$')} THEN w ELSE base END")},
        {"base": "left(w, length(w) - 1)"},
        {"w": kept("done", f"CASE WHEN {d.like('w', 'e$')} AND (length(base) >= r2 OR length(base) >= r1 "
                           f"AND NOT {_short(base, d)}) THEN base "
                           f"WHEN {d.like('w', 'll$')} AND length(base) >= r2 THEN base ELSE w END")},
        {"stem": f"CASE WHEN length(term) <= 2 THEN term ELSE "
                 f"{_case('term', {k: repr(v) for k, v in EN_EXCEPTIONS.items()}, 'replace(w, ' + repr('Y') + ', ' + repr('y') + ')')} END"},
    ]


# -- Spanish -----------------------------------------------------------------

_ES = "aeiouáéíóúü"

# Fixed values of the published algorithm: Spanish suffixes.
ES_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo",
               "las", "les", "los", "nos")
ES_PRONOUN_VERBS = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir",
                    "ando": "ando", "iendo": "iendo", "ar": "ar", "er": "er", "ir": "ir",
                    "yendo": "yendo"}
ES_PLAIN = ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables",
            "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento",
            "amientos", "imiento", "imientos")
ES_IC = ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias")
ES_REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente",
               "encias": "ente"}
ES_IDAD = ("idad", "idades")
ES_IV = ("iva", "ivo", "ivas", "ivos")
ES_Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
ES_GU_VERBS = ("en", "es", "éis", "emos")
ES_VERBS = (
    "arían", "arías", "arán", "arás", "aríais", "aría", "aréis", "aríamos", "aremos",
    "ará", "aré", "erían", "erías", "erán", "erás", "eríais", "ería", "eréis", "eríamos",
    "eremos", "erá", "eré", "irían", "irías", "irán", "irás", "iríais", "iría", "iréis",
    "iríamos", "iremos", "irá", "iré", "aba", "ada", "ida", "ía", "ara", "iera", "ad",
    "ed", "id", "ase", "iese", "aste", "iste", "an", "aban", "ían", "aran", "ieran",
    "asen", "iesen", "aron", "ieron", "ado", "ido", "ando", "iendo", "ió", "ar", "er",
    "ir", "as", "abas", "adas", "idas", "ías", "aras", "ieras", "ases", "ieses", "ís",
    "áis", "abais", "íais", "arais", "ierais", "aseis", "ieseis", "asteis", "isteis",
    "ados", "idos", "amos", "ábamos", "íamos", "imos", "áramos", "iéramos", "iésemos",
    "ásemos")
ES_RESIDUAL = ("os", "a", "o", "á", "í", "ó", "e", "é")


def spanish_steps(d: Dialect) -> list[dict[str, str]]:
    v, c = f"[{_ES}]", f"[^{_ES}]"

    def length_of(pattern: str) -> str:
        return f"length(regexp_extract(w, '({pattern})', 1))"

    rv = (f"CASE WHEN {d.like('w', f'^{v}{c}+{v}')} THEN {length_of(f'^{v}{c}+{v}')} "
          f"WHEN {d.like('w', f'^{v}{c}')} THEN 2 "
          f"WHEN {d.like('w', f'^{v}{v}+{c}')} THEN {length_of(f'^{v}{v}+{c}')} "
          f"WHEN {d.like('w', f'^{c}{c}+{v}')} THEN {length_of(f'^{c}{c}+{v}')} "
          f"WHEN {d.like('w', f'^{c}{v}.')} THEN 3 ELSE length(w) END")
    step1 = (*ES_PLAIN, *ES_IC, *ES_REPLACED, "amente", "mente", *ES_IDAD, *ES_IV)
    # what may go besides the suffix of step 1, given the rest of the word
    tails = (f"CASE WHEN e IN {_in(ES_IC)} THEN {_suffix('base', ('ic',))} "
             f"WHEN e = 'amente' THEN {_suffix('base', ('iv', 'os', 'ic', 'ad'))} "
             f"WHEN e = 'mente' THEN {_suffix('base', ('ante', 'able', 'ible'))} "
             f"WHEN e IN {_in(ES_IDAD)} THEN {_suffix('base', ('abil', 'ic', 'iv'))} "
             f"WHEN e IN {_in(ES_IV)} THEN {_suffix('base', ('at',))} ELSE '' END")
    return [
        {"w": "term"},
        {"rv": rv, "r1": _after_vowel_consonant("w", "0", _ES, d)},
        {"r2": _after_vowel_consonant("substr(w, r1 + 1)", "r1", _ES, d)},
        {"e": _suffix("substr(w, rv + 1)", ES_PRONOUNS)}, {"base": _cut("w", "e")},
        {"x": f"CASE WHEN e = '' THEN '' ELSE {_suffix('substr(base, rv + 1)', ES_PRONOUN_VERBS)} END"},
        {"base2": _cut("base", "x")},
        {"w": f"CASE WHEN x = '' THEN w WHEN x = 'yendo' THEN "
              f"CASE WHEN {d.like('base2', 'u$')} THEN base ELSE w END "
              f"ELSE base2 || {_case('x', {k: repr(t) for k, t in ES_PRONOUN_VERBS.items()}, repr(''))} END"},
        {"e": _suffix("w", step1)}, {"base": _cut("w", "e")},
        {"gone": "e <> '' AND length(base) >= CASE WHEN e = 'amente' THEN r1 ELSE r2 END"},
        {"x": tails}, {"base2": _cut("base", "x")},
        {"w": f"CASE WHEN NOT gone THEN w "
              f"WHEN e IN {_in(ES_REPLACED)} THEN base || {_case('e', {k: repr(t) for k, t in ES_REPLACED.items()}, repr(''))} "
              f"WHEN x = '' OR length(base2) < r2 THEN base "
              f"WHEN e = 'amente' AND x = 'iv' AND {d.like('base2', 'at$')} AND length(base2) - 2 >= r2 "
              f"THEN left(base2, length(base2) - 2) ELSE base2 END"},
        {"e": _suffix("substr(w, rv + 1)", ES_Y_VERBS), "x": _suffix("substr(w, rv + 1)", (*ES_GU_VERBS, *ES_VERBS))},
        {"base": _cut("w", "e"), "base2": _cut("w", "x")},
        {"w": f"CASE WHEN gone THEN w WHEN e <> '' AND {d.like('base', 'u$')} THEN base "
              f"WHEN x IN {_in(ES_GU_VERBS)} AND {d.like('base2', 'gu$')} THEN left(base2, length(base2) - 1) "
              f"ELSE base2 END"},
        {"e": _suffix("w", ES_RESIDUAL)}, {"base": _cut("w", "e")},
        {"w": f"CASE WHEN e = '' OR length(base) < rv THEN w "
              f"WHEN e IN ('e', 'é') AND {d.like('base', 'gu$')} AND length(base) - 1 >= rv "
              f"THEN left(base, length(base) - 1) ELSE base END"},
        {"stem": "CASE WHEN length(term) <= 2 THEN term ELSE translate(w, 'áéíóú', 'aeiou') END"},
    ]
