"""Word lists and thresholds of the Korean profile.

All of these are fixed values: results depend on them, so they are kept here,
together and in full.  Every operator takes its list as a parameter, so another
language is another profile.
"""

#: Substrings counted by the cheap prefilters.
PRONOUN_STRINGS_MRC = ["그는", "그가", "그의", "그녀", "이는", "이가", "저는", "그것"]
PRONOUN_STRINGS_PARAGRAPH = ["그는", "그가", "그의", "그녀", "이는", "이것", "그것"]
PRONOUN_STRINGS_STRICT = ["그는", "그가", "그의", "그녀는", "그녀가", "그것은"]
SPECIAL_CHARACTERS = "[](){}#@*"
LIST_STARTS = ["==", "##", "*", "-", "|"]

#: Pronouns by exact word.
PRONOUNS_SIMPLE = ["그", "그녀", "그것", "이", "그의", "그녀의", "이것", "저것", "그들", "이들"]
PRONOUNS_COUNTED = ["그", "그녀", "그것", "이", "저", "이것", "저것", "그들", "이들"]
PRONOUNS_PROFILE = ["그", "그녀", "그들", "이", "저", "이것", "그것", "저것", "자신", "본인", "당신"]
PARTICLES_SIMPLE = ["은", "는", "이", "가", "을", "를", "의", "에", "에서", "으로"]

#: Substrings of which two make a text rich in people, bodies and events.
INDICATORS = [
    "사람", "인물", "배우", "정치인", "작가", "화가", "음악가",
    "회사", "기업", "조직", "단체", "국가", "도시",
    "이야기", "역사", "사건", "발생", "참여", "관련",
]

#: Nouns too general to be an entity.
ENTITY_STOP = ["것", "수", "등", "때", "곳", "점", "년", "월", "일"]

# The tagger of this engine: a lexicon and shapes, no model.
TAGGER_PRONOUNS = ["그", "그녀", "그들", "이것", "그것", "저것", "이", "저", "우리", "저희", "자신", "당신", "본인", "이들"]
TAGGER_PARTICLES = ["에서는", "에서", "에게", "으로", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "만"]
TAGGER_NAME_SUFFIXES = [
    "재단", "은행", "대학", "신문", "조합", "공방", "협회", "물산", "해운", "극단", "연구소", "전자", "도서원", "상회", "농원",
    "마을", "평야", "고개", "포구",
]
TAGGER_VERB_ENDINGS = ["니다", "했다", "었다", "았다", "였다", "한다", "된다", "졌다", "어요", "아요", "해요", "하고", "하며", "하면서", "지만", "려고", "한", "된", "는가"]
TAGGER_ADVERBS = ["그리고", "그러나", "또한", "한편", "특히", "결국", "이미", "아직", "다시", "함께", "매우"]

MASK = "[MASK]"
