"""Stand-in tagger lexicons (our own fixed values, not taken from any model).

The neural taggers' weights are not available, so part of speech (D3) and
rhetorical category (D4) are assigned from these small closed lexicons by a
broadcast equi-join.  Both lists are fixed in size, so broadcasting them is
safe at any corpus size.
"""

from __future__ import annotations

# Closed-class English words and their CLAWS7 tags.
POS_LEXICON = {
    "the": "AT", "a": "AT1", "an": "AT1", "no": "AT",
    "of": "IO", "for": "IF", "with": "IW", "in": "II", "on": "II", "at": "II",
    "by": "II", "from": "II", "into": "II", "about": "II", "over": "II",
    "under": "II", "after": "II", "before": "II", "between": "II", "through": "II",
    "during": "II", "without": "IW", "within": "II", "upon": "II", "against": "II",
    "and": "CC", "or": "CC", "but": "CCB", "nor": "CC",
    "that": "CST", "if": "CS", "because": "CS", "while": "CS", "although": "CS",
    "though": "CS", "unless": "CS", "since": "CS", "than": "CSN", "as": "CSA",
    "whether": "CSW", "when": "RRQ", "where": "RRQ", "why": "RRQ", "how": "RRQ",
    "to": "TO", "not": "XX", "n't": "XX",
    "is": "VBZ", "are": "VBR", "was": "VBDZ", "were": "VBDR", "be": "VBI",
    "been": "VBN", "being": "VBG", "am": "VBM",
    "has": "VHZ", "have": "VH0", "had": "VHD", "having": "VHG",
    "do": "VD0", "does": "VDZ", "did": "VDD", "doing": "VDG", "done": "VDN",
    "will": "VM", "would": "VM", "can": "VM", "could": "VM", "may": "VM",
    "might": "VM", "must": "VM", "shall": "VM", "should": "VM",
    "it": "PPH1", "he": "PPHS1", "she": "PPHS1", "they": "PPHS2", "we": "PPIS2",
    "i": "PPIS1", "you": "PPY", "him": "PPHO1", "her": "APPGE", "them": "PPHO2",
    "us": "PPIO2", "me": "PPIO1", "his": "APPGE", "its": "APPGE", "their": "APPGE",
    "our": "APPGE", "my": "APPGE", "your": "APPGE",
    "this": "DD1", "these": "DD2", "those": "DD2", "some": "DD", "any": "DD",
    "all": "DB", "each": "DD1", "every": "AT1", "both": "DB2", "such": "DA",
    "other": "JJ", "many": "DA2", "much": "DA1", "more": "DAR", "most": "DAT",
    "which": "DDQ", "what": "DDQ", "who": "PNQS", "whom": "PNQO",
    "there": "EX", "here": "RL", "then": "RT", "now": "RT", "also": "RR",
    "very": "RG", "so": "RR", "only": "RR", "just": "RR", "however": "RR",
    "one": "MC1", "two": "MC", "three": "MC", "first": "MD", "second": "MD",
    "said": "VVD", "made": "VVN", "make": "VV0", "see": "VV0", "say": "VV0",
    "new": "JJ", "good": "JJ", "great": "JJ", "old": "JJ", "same": "DA",
}

# Rhetorical phrases (lower case, single spaces) and categories.
DS_LEXICON = {
    "the the": "Narrative",
    "of the": "InformationExposition",
    "in the": "InformationPlace",
    "on the": "InformationPlace",
    "at the": "InformationPlace",
    "and the": "MetadiscourseCohesive",
    "to the": "Facilitate",
    "it is": "ConfidenceHigh",
    "that is": "MetadiscourseCohesive",
    "is a": "InformationStates",
    "as a": "Description",
    "to be": "Future",
    "for the": "Facilitate",
    "with the": "Character",
    "by the": "Citation",
    "from the": "InformationTopics",
    "in spite of": "Reasoning",
    "as well as": "MetadiscourseCohesive",
    "on the other hand": "Reasoning",
    "because": "Reasoning",
    "therefore": "Reasoning",
    "however": "Contingent",
    "although": "Contingent",
    "perhaps": "ConfidenceHedged",
    "might": "ConfidenceHedged",
    "may": "ConfidenceHedged",
    "clearly": "ConfidenceHigh",
    "must": "ConfidenceHigh",
    "we": "FirstPerson",
    "i": "FirstPerson",
    "our": "FirstPerson",
    "you": "Interactive",
    "said": "InformationReportVerbs",
    "was": "Narrative",
    "he": "Character",
    "she": "Character",
    "they": "Character",
    "not": "Negative",
    "no": "Negative",
    "good": "Positive",
    "great": "Positive",
    "will": "Future",
    "this": "MetadiscourseCohesive",
    "that": "InformationStates",
    "and": "MetadiscourseCohesive",
    "if": "Contingent",
    "is": "InformationStates",
    "are": "InformationStates",
}


def ds_max_words() -> int:
    return max(len(p.split(" ")) for p in DS_LEXICON)


def pos_rows() -> list[tuple[str, str]]:
    return sorted(POS_LEXICON.items())


def ds_rows() -> list[tuple[str, int, str]]:
    return sorted((p, len(p.split(" ")), t) for p, t in DS_LEXICON.items())
