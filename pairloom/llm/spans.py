"""Candidate segments for personal information, and their whole-span features.

The grammars below are wide: they propose every span that could be an item. Which
proposals stand, with which boundaries and which type, is decided by the model in
``semicrf``. Positions are code points of the text given; characters of other widths
are read one for one, so positions do not move.
"""

from __future__ import annotations

import re
from typing import NamedTuple

KINDS = ["email", "phone", "id_number", "address", "name"]

# Frequent Korean family names, in order of the alphabet.
FAMILY = "강고곽구권길김나남노도류마맹명문민박방배백변봉서석선설성소손송신심안양엄여연염오옥왕용우원유육윤이임장전정제조주지진차채천최추태표하한함허현홍황"
# Family names of two syllables.
FAMILY_2 = "남궁|독고|동방|사공|서문|선우|제갈|황보"
# First and second syllables that given names often have, in order of the alphabet.
GIVEN_1 = "가강건경광규근기길나남다대덕도동두래만명문미민범병보봉상서석선성세소수순승시신아안양연영예오옥용우원유윤은을의이인일자재정제종주준중지진찬창채철춘충치태하한해향현형혜호홍화효훈희"
GIVEN_2 = "강건경관광교구권규균근기길남돈동락란련례린림만명모미민배백범복봉빈산삼상서석선섭성세솔수숙순슬승식신실아안애연열영예오옥완용우욱운웅원월유윤율은을의이익인일자재정종주준지진찬창채천철춘태택표하학한해혁현협형혜호홍화환후훈휘흠희"
# Nouns that are written like names, in order of the alphabet.
NOUNS = (
    "강도가 강의실 강화제 공기업 공동체 공유기 공정성 공지문 구성원 구두의 국기원 기대수 기술자 기지국 길이가 나이가 남성용 노동자 노인용 도서실 도덕성 문의자 문자열 문제지 문화재 문화원 민원인 민주화 방문자 방수화 배우자 백서 변동성 변수명 변호인 "
    "사용자 사유지 사진기 서명란 서식지 서기관 선정자 선수단 선호도 설명서 성명서 성장기 소비자 소수자 소유자 소유권 손상률 송금인 신규자 신문지 신용도 신원인 신분증 심의서 안내인 안내서 안전성 안정기 양도인 양수기 연기자 연수원 연대표 예산안 예술원 예약자 우대율 우선권 "
    "원동기 원인이 원자재 원주율 유기농 유동성 유명인 유지율 유효성 유의미 육성책 윤리성 은행원 이동식 이용자 이용률 이용권 이주민 이자율 이용료 임대인 임대료 임시직 임차인 임의성 임원실 의사록 이사회 장기화 장애인 전문의 전문서 전자식 전기료 전용면 정규화 정기권 정기성 정보원 정상화 정보지 정원수 정의역 "
    "제시안 제안서 제조원 조례안 조사원 조정안 조합원 주문서 주민세 주인공 주소지 주차장 주의보 주시기 주제별 지도자 지방세 지원자 지원서 지정일 지수화 지급일 진료실 진술서 진정서 차용인 차용증 채권자 채무자 채용일 천연가스 최대치 최소화 최적화 최종본 추정치 추천서 태양광 표준화 표시광 "
    "하도급 하수도 하한선 한도액 한시적 허가증 허용치 현금화 현장직 현재가 황금기 홍보실 홍수기"
).split()
# Longer nouns that end like a name with a particle.
LONG_NOUNS = "신용한도 이용한도 대기수요 전자지도 안전지도 유기성도 정밀지도 주의정도 공시지가 기준지가 전문의가 남용의도 선의의도 이용의도 정상수도 지하수도 임상의도 이상기도".split()
# Frequent English given names.
ENGLISH_GIVEN = (
    "Aaron|Adam|Alan|Alex|Alice|Amanda|Amy|Andrew|Angela|Anna|Anne|Anthony|Barbara|Benjamin|Betty|Brian|Carol|Catherine|Charles|Chris|Christine|Christopher|Daniel|David|Deborah|Diana|Donald|"
    "Dorothy|Edward|Eleanor|Elizabeth|Emily|Emma|Eric|Frank|George|Grace|Hannah|Helen|Henry|Jack|Jacob|James|Jane|Janet|Jason|Jennifer|Jessica|Joan|John|Jonathan|Joseph|Joshua|Julia|Karen|"
    "Katherine|Kevin|Laura|Linda|Lisa|Lucy|Margaret|Maria|Mark|Martha|Martin|Mary|Matthew|Michael|Michelle|Nancy|Nicholas|Oliver|Olivia|Patricia|Paul|Peter|Philip|Rachel|Rebecca|Richard|"
    "Robert|Ruth|Ryan|Samuel|Sandra|Sarah|Scott|Simon|Sophia|Stephen|Steven|Susan|Thomas|Timothy|Victoria|Walter|William"
)
# Digits as Korean words.
DIGIT_WORDS = "공영일이삼사오육륙칠팔구"
ENGLISH_DIGITS = "zero|oh|one|two|three|four|five|six|seven|eight|nine"

#: Wide characters read as their ASCII counterpart, one for one; all white space is one sign.
WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {
    **dict.fromkeys([0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], 0x20), 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D,
}

_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|AT)\s?[\])}>]\s?|\s(?:at|AT|골뱅이|앳)\s|골뱅이)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT)\s?[\])}>]\s?|\s(?:dot|DOT|닷|점)\s|닷|점)"
_UNIT = r"[가-힣]{1,7}(?:특별자치도|특별자치시|특별시|광역시|도|시|군|구|읍|면|동|리|가)"
_HOUSE = r"\d{1,5}(?:-\d{1,5})?"
_INSIDE = r"(?:\s*,?\s*(?:[가-힣A-Za-z]{1,10}\s?)?(?:지하\s?)?\d{1,5}\s?(?:동|호|층)(?![가-힣]))"
_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Way|Drive|Dr|Court|Ct|Place|Pl|Boulevard|Blvd|Square|Sq|Terrace|Row|Hill|Crescent|Quay|Walk|Mews|Parkway|Highway)"
_TOWN = r"(?:, [A-Z][a-z]+(?: (?!(?:SENTENCE)\b)[A-Z][a-z]+)?(?:, [A-Z]{2}\b(?![:：])(?: \d{5}\b)?)?)?"
# Words that begin an English sentence or field.
_SENTENCE = "The|Every|A|An|Our|If|Neither|Please|Item|Tel|Phone|Name|Signed|Dr|Mr|Ms|Mrs|Call|Send|It|In|No|Write|ID|Address|Applicant|Each|When|This|That|These|For|To|Receipt|Identity|Passport|She|He|They|We|You|Follow|Mobile|All|Any|As|At|By|On"
_ONE = rf"[{FAMILY}]"
_EN_NAME = r"[A-Z][a-z'’]+"
_BEFORE_NUMBER, _AFTER_NUMBER = r"(?<![\d])(?<!\d[-.])", r"(?!\d|[-.]\d)"

GRAMMARS: list[tuple[str, str, re.Pattern]] = [
    (kind, name, re.compile(rx))
    for kind, name, rx in [
        ("email", "mail", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]*[A-Za-z][A-Za-z0-9-]*)+"),
        ("phone", "intl", rf"(?<![\w+])\+\d{{1,3}}[\s.-]?(?:\(0?\d{{1,4}}\)|\d{{1,4}})[\s.-]?\d{{3,4}}[\s.-]?\d{{4}}{_AFTER_NUMBER}"),
        ("phone", "trunk", rf"{_BEFORE_NUMBER}(?:\(0\d{{1,3}}\)|0\d{{1,3}}\)?)\s?[.-]?\s?\d{{3,4}}\s?[.-]?\s?\d{{4}}{_AFTER_NUMBER}"),
        ("phone", "area", rf"{_BEFORE_NUMBER}(?<!\+)(?:1[ .-])?(?:\([2-9]\d\d\)\s?|[2-9]\d\d[ .-])\d{{3}}[ .-]\d{{4}}{_AFTER_NUMBER}"),
        ("phone", "service", rf"{_BEFORE_NUMBER}1[5689]\d\d[ .-]\d{{4}}{_AFTER_NUMBER}"),
        ("phone", "words", rf"(?<![가-힣])(?:공|영)[{DIGIT_WORDS}]{{1,2}}[\s-]{{0,3}}[{DIGIT_WORDS}]{{3,4}}[\s-]{{0,3}}[{DIGIT_WORDS}]{{4}}"),
        ("phone", "english_words", rf"(?i)(?<![A-Za-z])(?:{ENGLISH_DIGITS})(?:[\s,-]{{1,2}}(?:{ENGLISH_DIGITS})){{6,14}}(?![A-Za-z])"),
        ("id_number", "resident", rf"{_BEFORE_NUMBER}\d{{6}}(?:\s?-\s?|\s)?\d{{7}}{_AFTER_NUMBER}"),
        ("id_number", "passport", r"(?<![A-Za-z0-9])[A-Z](?:\d{3}[A-Z]\d{4}|\d{8}|[A-Z]\d{7})(?![A-Za-z0-9])"),
        ("id_number", "licence", rf"{_BEFORE_NUMBER}\d{{2}}(?:\s?-\s?|\s)\d{{2}}(?:\s?-\s?|\s)\d{{6}}(?:\s?-\s?|\s)\d{{2}}{_AFTER_NUMBER}"),
        ("id_number", "social", rf"{_BEFORE_NUMBER}\d{{3}}(?:\s?-\s?|\s)\d{{2}}(?:\s?-\s?|\s)\d{{4}}{_AFTER_NUMBER}"),
        ("address", "korean", rf"(?<![가-힣])(?:{_UNIT}\s+){{1,6}}(?:[가-힣]{{1,8}}(?:로|길)\s?(?:\d{{1,4}}번?길\s?)?\s?(?:지하\s?)?{_HOUSE}|(?:산\s?)?{_HOUSE}\s?번지){_INSIDE}{{0,3}}"),
        ("address", "english", rf"(?<![\w-])\d{{1,5}}[A-Z]?\s(?:(?:[A-Z][a-z'’]+|[NSEW]\.?)\s){{1,4}}{_STREET}\b\.?(?:\s(?:[NS][EW]?|[EW])\b\.?)?(?:,?\s(?:Unit|Apt|Apartment|Floor|Suite|Flat|Room)\.?\s?#?\w{{1,6}})?{_TOWN.replace("SENTENCE", _SENTENCE)}"),
        ("address", "box", rf"(?<![A-Za-z])(?:P\.?\s?O\.?\s?Box)\s\d{{1,6}}\b{_TOWN.replace('SENTENCE', _SENTENCE)}|사서함\s?(?:제)?\d{{1,5}}호?"),
    ]
]

# Words that often announce or follow an item, by what they speak for. They are
# features of a span, no condition for it.
CUES = {
    "id": ["주민등록번호", "주민번호", "신분번호", "등록번호", "면허번호", "면허 번호", "여권번호", "여권 번호", "외국인등록번호", "신분증", "신원", "본인", "ID", "id", "Identity", "identity", "Passport", "passport", "Social security", "SSN", "Licence", "License", "licence", "license"],
    "phone": ["전화번호", "전화", "휴대전화", "휴대폰", "연락처", "회신 번호", "Tel", "TEL", "tel", "Phone", "phone", "Mobile", "mobile", "Call", "call", "☎", "팩스", "Fax"],
    "mail": ["이메일", "메일", "E-mail", "e-mail", "Email", "email", "회신 주소", "write to"],
    "address": ["주소", "소재지", "거주지", "배송지", "Address", "address", "lives at", "located at", "moved to"],
    "name": ["담당자", "담당", "성명", "이름", "작성자", "신청인", "민원인", "대표자", "수신인", "보호자", "예금주", "Name", "Signed by", "signed by", "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "Contact", "Attn", "Dear"],
    "other": ["접수번호", "고시 제", "공고 제", "제", "바코드", "LOT-", "로트", "버전 v", "버전", "계좌번호", "계좌", "영수증", "송장", "주문번호", "사건번호", "문서번호", "관리번호", "No.", "표", "표준번호", "Receipt", "receipt", "Receipt number", "receipt number", "Notice", "notice", "Barcode", "barcode", "Lot", "lot", "Article", "Version", "version v", "order", "Order", "Invoice", "case", "Case"],
}
ROLES = ["님", "씨", "과장", "주무관", "선생님", "선생", "팀장", "부장", "부사장", "사장", "차장", "대리", "사원", "대표", "교수", "박사", "변호사", "의원", "이사", "소장", "국장", "계장", "사무관", "간호사", "담당관", "귀하", "드림", "올림", "군", "양", "외"]
_LEFT = {c: k for k, words in CUES.items() for c in words}
_LEFT_RX = re.compile("(" + "|".join(map(re.escape, sorted(_LEFT, key=len, reverse=True))) + r")(?:(?<=[가-힣])(?:은|는|이|가|의|께))?[\s:：.()\[\]|/#<]*$")
_LABEL_RX = re.compile(r"[A-Za-z가-힣]\s*[:：]\s*$")
_WORD_RX = re.compile(r"([A-Za-z가-힣]{1,12})[^A-Za-z가-힣]{0,3}$")
_ROLE = "(?:" + "|".join(sorted(ROLES, key=len, reverse=True)) + ")(?=[^가-힣]|$|[은는이가께의도를을과와에만])"
_ROLE_RX = re.compile(rf"\s?({_ROLE})")
_PARTICLE = r"(?:이라고|라고|이라는|라는|입니다|이었다|이다|이고|이며|이나|에게서|에게|한테|께서|에서|까지|부터|보다|처럼|은|는|이|가|을|를|과|와|의|도|께|에|만|랑|아|야)(?![가-힣])"
_PARTICLE_RX = re.compile(_PARTICLE)
_NAME_CUE = "|".join(map(re.escape, sorted((w for w in CUES["name"] if "가" <= w[0] <= "힣"), key=len, reverse=True)))
# a name of any syllables after a label or before a role
_NAME_RX = re.compile(rf"(?<![가-힣])(?:(?:{_NAME_CUE})(?:은|는)?\s*[:：]?\s*|[가-힣]{{1,8}}\s?[:：]\s*)(?=({_ONE}\s?[가-힣]{{1,3}}))")
_NAMED_ROLE_RX = re.compile(rf"(?<![가-힣])({_ONE}\s?[가-힣]{{2}})(?=\s?{_ROLE})")
# a name by its own syllables, anywhere
_SHAPE_RX = re.compile(rf"(?<![가-힣])((?:{FAMILY_2}|{_ONE})[{GIVEN_1}][{GIVEN_2}])(?=[^가-힣]|$|{_PARTICLE}|{_ROLE})")
_EN_GIVEN_RX = re.compile(rf"(?:{ENGLISH_GIVEN})\b")
_EN_NAME_RX = re.compile(rf"(?<![A-Za-z'’])(?=((?!(?:{_SENTENCE})\b){_EN_NAME}(?:\s[A-Z]\.)?\s(?!(?:{_SENTENCE}|{_STREET})\b){_EN_NAME})(?![A-Za-z]))")
_EN_TURNED_RX = re.compile(rf"(?<![A-Za-z'’])(?=((?!(?:{_SENTENCE})\b){_EN_NAME},\s(?!(?:{_SENTENCE})\b){_EN_NAME})(?![A-Za-z]))")
_MORE_RX = re.compile(rf"\s(?!(?:{_SENTENCE})\b)[A-Z][a-z]")
_CAP_BEFORE_RX = re.compile(r"([A-Z][a-z'’]+)\s$")
_SENTENCE_RX = re.compile(rf"(?:{_SENTENCE}|Regards|Sincerely|Manager|Director)$")
_LEVEL = [("특별자치도", 5), ("특별자치시", 5), ("특별시", 5), ("광역시", 5), ("도", 5), ("시", 4), ("군", 4), ("구", 3), ("읍", 2), ("면", 2), ("동", 1), ("리", 1), ("가", 1)]

#: RE2 pattern of the lines that ``WIDE`` changes.
WIDE_CLASS = "[" + "".join(sorted(map(chr, WIDE))) + "]"
#: RE2 patterns: a line (read through ``WIDE``) without a match holds no span of the grammars that
#: name the gate (checked by a test).
GATES = {
    "mail": r"@|[\[({<]\s?(?:at|AT)\s?[\])}>]|\s(?:at|AT|골뱅이|앳)\s|골뱅이",
    "number": r"[0-9](?:[\s.()\-]{0,4}[0-9]){6}",
    "words": rf"[공영][{DIGIT_WORDS}]",
    "english_words": rf"(?i)(?:{ENGLISH_DIGITS})[\s,-]{{1,2}}(?:{ENGLISH_DIGITS})",
    "passport": r"[A-Z](?:[0-9]{3}|[A-Z][0-9]{3})",
    "korean": r"(?:로|길)\s?(?:지하\s?)?[0-9]|[0-9]\s?번지",
    "english": r"[0-9][A-Z]?\s[A-Z]",
    "box": r"Box\s[0-9]|사서함",
    "label": rf"(?:{_NAME_CUE})(?:은|는)?\s*[:：]?\s*{_ONE}|[가-힣]\s?[:：]\s*{_ONE}",
    "role": rf"{_ONE}\s?[가-힣]{{2}}\s?(?:{'|'.join(ROLES)})",
    "shape": rf"(?:^|[^가-힣])(?:{FAMILY_2}|{_ONE})[{GIVEN_1}][{GIVEN_2}]",
    "english_name": r"[A-Z][a-z'’]+\s(?:[A-Z]\.\s)?[A-Z][a-z'’]",
    "turned": r"[A-Z][a-z'’]+,\s[A-Z][a-z'’]",
}
_GATE_OF = {"mail": "mail", "words": "words", "english_words": "english_words", "passport": "passport", "korean": "korean", "english": "english", "box": "box"}
_BIT = {g: 1 << i for i, g in enumerate(GATES)}
_GATED = [(kind, name, rx, _BIT[_GATE_OF.get(name, "number")]) for kind, name, rx in GRAMMARS]


NOUN_SET = frozenset(NOUNS + LONG_NOUNS)


class Span(NamedTuple):
    start: int
    end: int
    kind: int
    features: tuple[str, ...]


def _left(s: str, at: int) -> str:
    m = _LEFT_RX.search(s, max(0, at - 22), at)
    if m:
        return _LEFT[m.group(1)] + (":" if ":" in m.group() or "：" in m.group() else "")
    return "label" if _LABEL_RX.search(s, max(0, at - 6), at) else "none" if s[:at].strip() else "begin"


def _right(s: str, at: int) -> str:
    nxt = s[at : at + 1]
    if m := _ROLE_RX.match(s, at):
        return "role" if m.group(1) != "외" else "others"
    if not nxt or nxt in "\r\n\t|/,":
        return "end"
    if nxt in "호건":
        return "counter"
    if nxt == " ":
        after = s[at + 1 : at + 3]
        if after in ("건은", "건의", "상품", "호를"):
            return "counted"
        if _PARTICLE_RX.match(s, at + 1):
            return "particle"
        return "space" if "가" <= after[:1] <= "힣" else "end" if not after[:1].isalnum() else "latin"
    if m := _PARTICLE_RX.match(s, at):
        return "particle" if len(m.group()) == 1 else "particles"
    return "hangul" if "가" <= nxt <= "힣" else "latin" if nxt.isalnum() else "sign"


def _valid(name: str, text: str) -> str:
    if name == "resident":
        d = re.sub(r"\D", "", text)
        return "date" if 1 <= int(d[2:4]) <= 12 and 1 <= int(d[4:6]) <= 31 and d[6] in "12345678" else "nodate"
    if name == "korean":
        levels = [next(v for w, v in _LEVEL if u.endswith(w)) for u in re.findall(rf"{_UNIT}(?=\s)", text)]
        down = all(a > b or (a == b == 4) or a == b == 1 for a, b in zip(levels, levels[1:]))
        return ("down" if down else "mixed") + ("top" if levels and levels[0] >= 4 else "low")
    if name == "mail":
        return ("@" if "@" in text else "word" if re.search(r"\s(?:at|AT)\s", text) else "sign") + ("." if "." in re.split(r"@|at|AT|골뱅이|앳", text)[-1] else "dot")
    if name in ("trunk", "area", "intl"):
        return ".".join(str(len(x)) for x in re.findall(r"\d+", text))
    return "-"


def _features(kind: str, name: str, l: str, r: str, v: str) -> tuple[str, ...]:
    return (f"k={kind}", f"g={name}", f"g={name},l={l}", f"g={name},r={r}", f"g={name},v={v}", f"k={kind},l={l},r={r}", f"g={name},l={l},v={v}")


def _span(s: str, start: int, end: int, kind: str, name: str) -> Span:
    return Span(start, end, KINDS.index(kind), _features(kind, name, _left(s, start), _right(s, end), _valid(name, s[start:end])))


def _word(s: str, at: int) -> str:
    m = _WORD_RX.search(s, max(0, at - 16), at)
    return m.group(1).lower() if m else "-"


def _korean_name(s: str, start: int, end: int, nouns: frozenset[str]) -> Span:
    """Features: where the syllables stand in given names, which they are, a role inside, the word before."""
    text = s[start:end].replace(" ", "")
    family = 2 if text[:2] in FAMILY_2.split("|") and len(text) > 3 else 1
    given = text[family:]
    name = f"korean{len(text) - family + 1}{'s' if ' ' in s[start:end] else ''}"
    l, r = _left(s, start), _right(s, end)
    r = "space" if r in ("counter", "counted") and s[end : end + 1] == " " else r
    alone = not l.startswith("name") and r not in ("role", "others")  # nothing else speaks for it
    usual = "usual" if len(given) == 2 and given[0] in GIVEN_1 and given[1] in GIVEN_2 else "other"
    usual = "noun" if text in nouns or s[start : end + 1] in nouns or text[:-1] in _LEFT else usual if alone else "-"
    inside = ",role" if any(given.startswith(x) for x in ROLES if len(x) > 1) else ""
    more = (f"w={_word(s, start)}", f"usual={usual},l={l}", f"usual={usual},r={r}")
    if alone:
        particle = m.group() if (m := _PARTICLE_RX.match(s, end)) else "-"
        more += (f"n={given}", f"n1={given[:1]}", f"n2={given[1:2]}", f"n=last,{given[-1:]},{r}", f"p={particle}", f"usual={usual},p={particle}")
    return Span(start, end, KINDS.index("name"), _features("name", name, l, r, usual + inside) + more)


def _english_name(s: str, start: int, end: int, turned: bool) -> Span:
    """Features: a frequent given name, capitals around, a line of capitals only, the word before."""
    given = "given" if _EN_GIVEN_RX.match(s, s.index(", ", start) + 2 if turned else start) else "other"
    m = _CAP_BEFORE_RX.search(s, max(0, start - 16), start)
    before = ",before" if m and not _SENTENCE_RX.match(m.group(1)) else ""
    more = ",more" if _MORE_RX.match(s, end) else ""
    title = ",title" if not re.search(r"(?<![A-Za-z'’])[a-z]", s) else ""
    l, r = _left(s, start), _right(s, end)
    name = "turned" if turned else "english"
    return Span(start, end, KINDS.index("name"), _features("name", name, l, r, given + before + more + title) + (f"ew={_word(s, start)},{before}{more}", f"given={given},l={l}", f"around={before}{more}{title}"))


def open_gates(lines):
    """For each line of an Arrow array (read through ``WIDE``) the bits of the gates it passes."""
    import numpy as np
    import pyarrow.compute as pc

    bits = np.zeros(len(lines), dtype="int64")
    for gate, pattern in GATES.items():
        bits |= np.where(pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False), _BIT[gate], 0)
    return bits


def candidates(s: str, nouns: frozenset[str] = NOUN_SET, gates: int = -1) -> list[Span]:
    """All candidate spans of one line (already read one for one through ``WIDE``) that the open gates let pass."""
    out = []
    for kind, name, rx, bit in _GATED:
        for m in rx.finditer(s) if gates & bit else ():
            out.append(_span(s, m.start(), m.end(), kind, name))
            if name == "korean":  # the chain of units may begin at any of its units
                for u in list(re.finditer(rf"{_UNIT}\s+", m.group()))[1:4]:
                    out.append(_span(s, m.start() + u.start(), m.end(), kind, name))
    seen = set()
    for rx, gate in ((_NAME_RX, "label"), (_NAMED_ROLE_RX, "role")):
        for m in rx.finditer(s) if gates & _BIT[gate] else ():
            at = m.start(1)
            spaced = s[at + 1 : at + 2] == " "
            for n in (4,) if spaced else (2, 3, 4):
                end = at + n
                if end <= m.end(1) and (at, end) not in seen and " " not in s[at + 2 : end]:
                    r = _right(s, end)
                    if (r == "hangul" or s[end : end + 1].isalnum()) and r not in ("role", "others", "particle", "particles") and not (spaced is False and n == 3 and s[end : end + 1] in "님씨"):
                        continue
                    seen.add((at, end))
                    out.append(_korean_name(s, at, end, nouns))
    for m in _SHAPE_RX.finditer(s) if gates & _BIT["shape"] else ():
        if m.span(1) not in seen:
            seen.add(m.span(1))
            out.append(_korean_name(s, *m.span(1), nouns))
    for rx, turned in ((_EN_NAME_RX, False), (_EN_TURNED_RX, True)):
        for m in rx.finditer(s) if gates & _BIT["turned" if turned else "english_name"] else ():
            out.append(_english_name(s, *m.span(1), turned))
    out.sort(key=lambda c: (c.end, c.start))
    return out
