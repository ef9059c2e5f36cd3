"""What a script or a language brings to the operators: alphabets, folds, marks and closed word lists.

Operators take a profile; none of them knows a language. All values below are fixed values of the scripts.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    name: str
    letters: str  # a character class body
    vowels: str  # marks that say how a word ends
    other_marks: str
    stretch: str  # shaping characters that are neither letter nor mark
    fold: tuple[str, str]  # letters folded for keys, position by position
    root_fold: tuple[str, str]  # further folds for roots
    hamza_seats: tuple[str, str] = ("", "")
    weak: str = ""
    weak_ends: str = ""  # letters that stand for one another at the end of a root, in the order they are tried
    seats: str = ""
    letter_forms: tuple[str, str] = ("", "")  # forms of other languages that stand for one letter everywhere
    block: str = ""  # a character class body: the script's block, punctuation included
    run_marks: str = ""  # the marks that do not end a stretch of it
    placed_yeh: str = ""  # forms that are yeh_dotted or yeh_bare by their place
    yeh_dotted: str = ""
    yeh_bare: str = ""
    kasra: str = ""
    plain_vowels: str = ""
    doubling: str = ""
    genitive: tuple[str, ...] = ()  # keys of the particles that govern the genitive, the accusative
    accusative: tuple[str, ...] = ()
    genitive_ends: str = ""
    accusative_ends: str = ""
    son: tuple[str, ...] = ()  # keys of the words that take the case of the name before them

    @property
    def marks(self) -> str:
        return self.vowels + self.other_marks

    @property
    def strip(self) -> str:
        return self.marks + self.stretch


ARABIC = Profile(
    name="arabic",
    letters="ء-ي",
    vowels="ًٌٍَُِ",
    other_marks="ّْٰٕٓٔ",
    stretch="ـ",
    fold=("أإآىةئؤ", "اااي" + "هءء"),
    root_fold=("ء", "ا"),
    hamza_seats=("أإآؤئ", "ءءءءء"),
    weak="وي",
    weak_ends="يىو",
    seats="ءأإآا",
    letter_forms=("کھہڃ", "كههج"),
    block="\u0600-\u06ff",
    run_marks="ًٌٍَُِّْٰ",
    placed_yeh="یے",
    yeh_dotted="ي",
    yeh_bare="ى",
    kasra="ِ",
    plain_vowels="َُِ",
    doubling="ّ",
    genitive=("من", "في", "علي", "عن", "الي", "مع", "عند", "بين", "لدي", "حتي", "منذ", "خلال", "قبل", "بعد", "فوق", "تحت", "دون", "سوي", "نحو"),
    accusative=("ان", "كان", "لكن", "لعل", "ليت", "انما"),
    genitive_ends="ٍِ",
    accusative_ends="ًَ",
    son=("بن", "ابن", "بنت"),
)

LATIN = Profile(
    name="latin",
    letters="A-Za-zÀ-ÖØ-öø-ÿ",
    vowels="̀́̂̈",
    other_marks="̧̃",
    stretch="­",
    fold=("éèêëàâäçîïôöûüùñÉÈÊÀÂÄÇÎÔÖÛÜÑ", "eeeeaaaciioouuunEEEAAACIOOUUN"),
    root_fold=("y", "i"),
)
