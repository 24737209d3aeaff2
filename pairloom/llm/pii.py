"""Problem 10: personal information inside free text.

Method: a semi-Markov conditional random field. Wide grammars propose spans, whole-span
features (grammar, cue to the left, what follows, validity) score them, and bounded
dynamic programming chooses boundaries and types together. The model is trained here, in
seconds, on lines written by the generator below, with invented names and numbers; it
sees no row of the data.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.semicrf import SemiCRF
from pairloom.llm.spans import DIGIT_WORDS, ENGLISH_GIVEN, FAMILY, FAMILY_2, GIVEN_1, GIVEN_2, KINDS, LONG_NOUNS, NOUN_SET, NOUNS, WIDE, WIDE_CLASS, candidates, open_gates

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Lines of the training generator: {kind} is an item, {x:…} a value that is none. ``known`` is a
# name of usual syllables or with a usual given name, the others are of any syllables.
LINES = [
    "메일 {email}", "E-mail: {email}", "이메일은 {email} 이다.", "질문은 {email}", "원고를 {email} 로 부쳐 주십시오.", "Mail {email} before noon.", "Her address is {email} now.", "<{email}> 에게도 전달했다.", "담당 창구({email})에 남겼다.", "아이디 {x:handle} 로 접속한다.", "See {x:handle} on the board.",
    "Look at {x:site} for details.", "we arrived at {x:site} late", "Reports at {x:site} are old.", "{email} / {phone}",
    "전화 {phone}", "연락처 {phone} 이다.", "Tel. {phone}", "Phone: {phone}", "휴대폰: {phone} (오전)", "☎ {phone}", "{phone} 에 걸어 보십시오.", "Dial {phone} at night.", "You can reach us on {phone} daily.", "담당 직통 {phone}, 휴일 제외", "{phone} 로 문자를 남긴다.", "Fax {phone}",
    "주민등록번호 {id_number} 기재", "주민번호 {id_number}", "신분번호: {id_number}", "면허번호({id_number}) 사본", "본인임을 밝히려고 {id_number} 를 냈다.", "ID: {id_number}", "ID no. {id_number}", "The clerk copied {id_number} from the paper.", "{id_number} 기입", "등록번호: {id_number}", "여권 {id_number} 분실", "My passport is {id_number} (old)",
    "접수번호 {x:receipt} 처리", "고시 제{x:receipt}호", "바코드 {x:barcode}", "로트 LOT-{x:lot}", "개정 버전 v{x:version}", "계좌번호 {x:account}", "Receipt number {x:receipt} is here.", "Invoice {x:account} is due.", "총액 {x:amount}원", "{x:year}년 {x:month}월 {x:month}일 제{x:month}조", "송장 {x:barcode} 확인", "표 {x:lot} 참조", "Table {x:lot} shows it.", "Part {x:lot} is out.", "{x:barcode} 상품", "제{x:receipt}호를 고친다.",
    "주소 {address}", "주소: {address}", "소재지: {address}", "가게는 {address} 에 있다.", "{address}", "모임 장소({address})", "짐은 {address} 으로 옮긴다.", "Address: {address}", "Deliver to {address}.", "He stayed at {address} in June.", "Their shop, {address}", "주소 체계를 배운다.", "주소가 없다.", "{x:city} 규정을 {x:month} 번 읽었다.", "Mail to {box}.", "{box}",
    "담당 {name}", "성명 {name}", "성명: {name}", "작성자: {name}", "담당자는 {name} 과장이다.", "{name}님, 오셨습니까", "{name} 씨가 앉았다.", "오늘 {name} 선생님께 배웠다.", "예약은 {name} 주무관이 받는다.", "신청인 {name} 은 기다린다.", "민원인 {name} 외 한 명", "이름: {name}", "{name} 교수의 강의", "{name} 팀장과 만났다.",
    "{known}가 왔다.", "{known}는 집에 있다.", "어머니는 {known}이라고 부른다.", "나는 {known}를 안다.", "친구 {known}에게 주었다.", "발신: {known}", "받는 사람: {known}", "{known} 부사장이 말했다.", "그때 {known}와 걸었다.", "{known}", "보고자 {known}", "{known} 드림", "오늘은 {known}의 생일", "{known}, {known} 참석", "제 이름은 {known}입니다",
    "Name: {enname}", "Signed by {enname}", "Dr. {enname} came in.", "Mr. {enname} left.", "A letter for {enname} is here.", "The claim by {enname} was read.", "Contact: {enname}", "Dear {enname},",
    "My brother is {enknown}", "They saw {enknown} today.", "Editor: {enknown}", "Best wishes, {enknown}", "{enknown} wrote the note.", "I told {enknown} about it.", "{enknown} and {enknown} agreed.", "according to {enknown}, it rained", "She works with {enknown}.", "{enknown}",
    "담당 {x:office}", "담당 {x:office} 확인", "담당자 미정", "작성자: 비공개", "성명은 적지 않는다.", "Dr. on duty: unknown.", "Name and place withheld.", "오늘 {x:word} 자료를 읽었다.", "{x:word} 담당 부서는 {x:word}을 읽는다.", "담당자가 살핀 {x:word} 까닭에", "고객님, 오셨습니까", "회원님께 드린다.", "이용자님 안내", "남선생님께 여쭈었다.", "김 과장이 왔다.", "이 팀장과 만났다.", "담당 {x:noun}", "분류: {x:noun}", "제목: {x:word}", "구분 : {x:noun}{x:josa}",
    "The order by {x:title} was read.", "A box for the {x:title} is here.", "to {x:title} and", "{x:title}", "# {x:title}", "The {x:title} opens.", "{x:pair} Handbook", "In {x:pair} the file is kept.", "Every {x:pair} item", "{x:pair} rules for the desk", "according to {x:pair} rules", "{x:pair}, {x:pair}", "Section: {x:pair}",
    "{x:noun}{x:josa} 늘었다.", "올해 {x:noun}{x:josa} 바뀐다.", "{x:noun}{x:josa} {x:noun}{x:josa} 다르다.", "{x:noun} 목록", "{x:noun}", "모든 {x:noun}{x:josa} 본다.", "새 {x:noun} {x:noun} 정리", "- {x:noun} 안내", "{x:noun}이라고 적는다.", "{x:noun}입니다.", "등록된 {x:noun}{x:josa} 두 번 센다.",
    "{x:adnominal} {x:noun}{x:josa} 본다.", "모두 {x:adnominal} 자료", "따로 {x:adnominal}", "{x:adnominal}", "{x:adnominal} {x:word}", "미리 {x:adnominal} 것", "{x:topic} 크게 늘었다.", "올해 {x:topic} 바뀐다.", "{x:topic} {x:topic} 다르다.", "{x:adnominal} {x:word}을 {x:adnominal} {x:noun} 안내",
    "근거: {x:word} {x:noun}", "제목: {x:word} 자료", "출처: {x:word}", "구분: {x:noun} {x:word}", "비고: {x:adnominal} {x:noun}", "제목: {x:noun}{x:josa} 모음", "질문: {x:topic} 어떻습니까",
    "He lives at {enaddress} since May.", "The shop at {enaddress} is shut.", "{enaddress}", "We moved from {enaddress} last year.", "Her house, {enaddress}, is old.", "Address: {enaddress}",
    "담당 {name} / {email}", "담당 {name}, 신분번호: {id_number}", "성명 {name} | {phone}", "{x:place} {x:noun} {x:noun}", "# {x:place} {x:noun} 모음", "[{x:place} {x:noun} 모음]", "{x:place} {x:word} 이야기", "{known}와 {known}은 벗이다.", "{known}에게서 왔다.",
    "담당 {name} 여권 {id_number}", "성명 {name} 그리고 {x:word} 자료", "담당 {name} 그때 {x:word} 자료", "작성자: {name} 또 {x:word}", "{name} 씨 가족", "Address: {address} Every {x:word}", "Address: {address} The file",
    "담당 창구에서 {x:word}을 다룬다.", "담당 공무원이 본다.", "작성자: 관리자", "작성자 명단은 없다.", "상담은 예약제로 한다.", "상담은 전화로만 받는다.", "민원인 전용 창구이다.", "이사 날짜를 적는다.", "신청인 성명은 뺀다.",
]

# Frequent Korean given names, in order of the alphabet.
GIVEN = (
    "가영 건우 경수 경희 기현 나연 도현 동현 명수 미경 미숙 민서 민재 민준 민지 병철 보미 상우 상훈 서연 서영 서윤 서준 선영 성민 성진 소영 수민 수빈 수아 수현 순자 승민 승현 시우 아영 연주 영수 영숙 영진 영철 예은 예준 "
    "용준 우진 원석 유나 유진 윤서 윤아 은지 은주 은희 인호 재민 재석 재호 정민 정숙 정훈 정희 종민 주연 주원 주희 준서 준영 준혁 준호 지민 지수 지아 지연 지영 지우 지원 지현 지혜 지호 진수 진영 진우 창민 철수 태현 하윤 하은 해인 현수 현우 현정 현주 현준 혜진 호진 효진"
).split()
_NOUN_ENDS = {n[1:3] for n in NOUNS}


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def syl(self, n: int) -> str:
        return "".join(chr(0xAC00 + self.r.randrange(19) * 588 + self.r.randrange(21) * 28 + self.r.choice([0, 0, 1, 4, 8, 16, 21])) for _ in range(n))

    def dig(self, n: int) -> str:
        return "".join(str(self.r.randrange(10)) for _ in range(n))

    def low(self, n: int) -> str:
        return "".join(self.r.choice("abcdefghilmnoprstuvw") for _ in range(n))

    def cap(self, n: int) -> str:
        return self.low(n).capitalize()

    def name(self) -> str:
        if self.r.random() < 0.3:
            return self.known()
        return self.r.choice(FAMILY) + self.r.choice(["", "", "", " "]) + self.syl(2)

    def known(self) -> str:
        family = self.r.choice(FAMILY) if self.r.random() < 0.92 else self.r.choice(FAMILY_2.split("|"))
        if self.r.random() < 0.5:
            return family + self.r.choice(GIVEN)
        while (given := self.r.choice(GIVEN_1) + self.r.choice(GIVEN_2)) in _NOUN_ENDS:
            pass
        return family + given

    def enknown(self) -> str:
        return f"{self.r.choice(ENGLISH_GIVEN.split('|'))} {self.cap(self.r.randint(4, 9))}"

    def box(self) -> str:
        return self.r.choice([f"PO Box {self.r.randint(1, 9999)}", f"P.O. Box {self.r.randint(1, 9999)}, {self.cap(6)}", f"사서함 {self.r.randint(1, 999)}호"])

    def enname(self) -> str:
        a, b = self.cap(self.r.randint(4, 7)), self.cap(self.r.randint(5, 9))
        return self.r.choice([f"{a} {b}", f"{a} {self.cap(1)}. {b}", f"{b}, {a}"])

    def email(self) -> str:
        at, dot = self.r.choice([("@", "."), ("@", "."), (" @ ", "."), ("[at]", "."), (" (at) ", " (dot) "), (" at ", " dot "), ("＠", "."), (" 골뱅이 ", " 점 ")])
        host = dot.join([self.low(5) for _ in range(self.r.randint(1, 2))] + [self.r.choice(["com", "net", "test", "example"])])
        return self.low(4) + self.r.choice(["", "_1", ".22", "+7"]) + at + host

    def phone(self) -> str:
        r = self.r
        if r.random() < 0.12:
            w = lambda n: "".join(r.choice(DIGIT_WORDS) for _ in range(n))
            return f"공일공 {w(4)} {w(4)}"
        if r.random() < 0.25:
            a, b, c = str(r.randint(200, 989)), self.dig(3), self.dig(4)
            return r.choice([f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])
        a, b, c = r.choice(["010", "02", "031", "051", "064"]), self.dig(r.choice([3, 4, 4])), self.dig(4)
        made = r.choice([f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a} - {b} - {c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}){b}-{c}", f"+82 {a[1:]} {b} {c}", f"+82-{a[1:]}-{b}-{c}", f"010{self.dig(8)}"])
        return made

    def birth(self) -> str:
        return f"{self.r.randint(40, 99)}{self.r.randint(1, 12):02d}{self.r.randint(1, 28):02d}"

    def id_number(self) -> str:
        r = self.r
        return r.choice([
            f"{self.birth()}-{r.randint(1, 4)}{self.dig(6)}", f"{self.birth()} - {r.randint(1, 4)}{self.dig(6)}", f"{self.birth()} {r.randint(1, 4)}{self.dig(6)}", f"{self.birth()}{r.randint(1, 4)}{self.dig(6)}",
            f"M{self.dig(8)}", f"M{self.dig(3)}{r.choice('ABCD')}{self.dig(4)}", f"{self.dig(2)}-{self.dig(2)}-{self.dig(6)}-{self.dig(2)}", f"9{self.dig(2)}-{self.dig(2)}-{self.dig(4)}", f"9{self.dig(2)} {self.dig(2)} {self.dig(4)}",
        ])

    def enaddress(self) -> str:
        r = self.r
        tail = r.choice(["", "", " NW", " E", f", Apt {r.randint(1, 40)}", f", Unit {r.randint(1, 40)}", f", Floor {r.randint(1, 30)}"])
        return f"{r.randint(1, 999)} {r.choice(['', '', 'Old ', 'New '])}{self.cap(6)} {r.choice(['Street', 'Lane', 'Road', 'Close', 'Ave.'])}{tail}, {r.choice([self.cap(6), self.cap(4) + ' ' + self.cap(5)])}"

    def address(self) -> str:
        r = self.r
        if r.random() < 0.3:
            return self.enaddress()
        units = [self.syl(2) + r.choice(["도", "특별시", "광역시", "특별자치도"])] if r.random() < 0.7 else []
        units += [self.syl(2) + r.choice(["시", "군"])] if r.random() < 0.9 or not units else []
        units += [self.syl(2) + "구"] if r.random() < 0.6 else []
        if r.random() < 0.3:
            units += ([self.syl(2) + "읍"] if r.random() < 0.4 else []) + [self.syl(2) + r.choice(["동", "리"]), f"{r.randint(1, 900)}-{r.randint(1, 60)}번지"]
        else:
            units += [self.syl(2) + r.choice(["로", "길", "대로"]) + r.choice(["", f"{r.randint(1, 90)}번길"]), f"{r.randint(1, 400)}" + r.choice(["", f"-{r.randint(1, 40)}"])]
        return " ".join(units) + r.choice(["", "", f", {r.randint(2, 20)}층", f" {r.randint(101, 120)}동 {r.randint(101, 2500)}호", f" {self.syl(2)}빌라 {r.randint(101, 500)}호"])

    def x(self, what: str) -> str:
        r = self.r
        return {
            "noun": lambda: r.choice(NOUNS) if r.random() < 0.85 else r.choice(LONG_NOUNS), "josa": lambda: r.choice(["은", "는", "이", "가", "을", "를", "과", "와", "의", "에", "도", "", ""]), "pair": lambda: f"{self.cap(r.randint(5, 9))} {self.cap(r.randint(4, 9))}",
            "adnominal": lambda: r.choice(FAMILY) + r.choice(GIVEN_1) + r.choice(["한", "진", "인", "할", "하는", "해진", "된"]), "topic": lambda: r.choice(FAMILY) + r.choice(GIVEN_1) + r.choice(["이", "은", "의", "인", "일", "도", "만"]),
            "place": lambda: r.choice(FAMILY) + r.choice(GIVEN_1) + r.choice(GIVEN_2),
            "site": lambda: f"{self.low(6)}.{r.choice(['com', 'net', 'test'])}",
            "handle": lambda: "@" + self.low(4) + "_desk",
            "receipt": lambda: f"20{self.dig(2)}{r.choice('03')}{self.dig(1)}-{self.dig(7)}" if r.random() < 0.5 else f"20{self.dig(2)}{r.randint(13, 99)}-{self.dig(7)}",
            "barcode": lambda: f"88{r.randint(13, 99)}{self.dig(9)}",
            "lot": lambda: f"0{self.dig(1)}-{self.dig(7)}",
            "version": lambda: f"0{self.dig(1)}.{self.dig(7)}.0",
            "account": lambda: f"{self.dig(3)}-{self.dig(2)}-{self.dig(5)}" if r.random() < 0.5 else f"{self.dig(6)}-{self.dig(2)}-{self.dig(6)}",
            "amount": lambda: f"{self.dig(3)},{self.dig(3)},{self.dig(3)}" if r.random() < 0.5 else str(r.randint(1_000_000, 99_999_999)),
            "year": lambda: str(r.randint(1990, 2026)), "month": lambda: str(r.randint(1, 12)),
            "city": lambda: self.syl(2) + r.choice(["도", "시", "특별시"]),
            "office": lambda: r.choice(["부서", "기관", "창구", "직원", "과", "공무원"]),
            "word": lambda: (r.choice(FAMILY) if r.random() < 0.6 else self.syl(1)) + self.syl(r.choice([2, 3, 3])),
            "title": lambda: f"{self.cap(7)} {self.cap(6)} {self.cap(6)}" if r.random() < 0.6 else f"{self.low(6)} {self.low(5)}",
        }[what]()


def _wide(text: str, r: random.Random) -> str:
    return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() or c == "-" else c for c in text) if r.random() < 0.1 else text


def training_lines(n: int = 7000, seed: int = 11):
    """``(text, {(start, end, kind)})`` lines: one to three parts from ``LINES``."""
    m, out = _Maker(seed), []
    lines = LINES + 2 * [x for x in LINES if "{x:" in x]  # most words that look like a name are none
    for i in range(n):
        text, gold = "", set()
        parts = [lines[i % len(lines)]] + [m.r.choice(LINES) for _ in range(m.r.choice([0, 0, 1, 2]))]
        for j, line in enumerate(parts):
            text += m.r.choice([" ", " ", " ", " / ", " | ", ", ", "\t"]) if j else ""
            at = 0
            for hole in re.finditer(r"\{(x:)?(\w+)\}", line):
                text += line[at : hole.start()]
                at = hole.end()
                if hole[1]:
                    text += m.x(hole[2])
                else:
                    made = _wide(getattr(m, hole[2])(), m.r)
                    kind = {"enname": "name", "known": "name", "enknown": "name", "box": "address", "enaddress": "address"}.get(hole[2], hole[2])
                    gold.add((len(text), len(text) + len(made), KINDS.index(kind)))
                    text += made
            text += line[at:]
        out.append((text, gold))
    return out


@lru_cache(maxsize=1)
def trained_weights(n: int = 7000, seed: int = 11) -> tuple[tuple[str, float], ...]:
    """Fit the model; a bounded set of ``n`` generated lines."""
    data = []
    for i, (text, gold) in enumerate(training_lines(n, seed)):
        # every other line is read without the list of nouns, so that syllables speak as well
        spans = candidates(text.translate(WIDE), NOUN_SET if i % 2 else frozenset())
        data.append((spans, gold))
    return tuple(sorted(SemiCRF().fit(data).w.items()))


def find_items(text: str, model: SemiCRF, lines=None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of a text, positions from 0, in order; lines are decoded apart."""
    out = []
    for at, line in lines if lines is not None else _lines(text):
        for c in model.decode(candidates(line.translate(WIDE))):
            out.append((KINDS[c.kind], at + c.start, at + c.end))
    return out


_BREAK = re.compile(r"[^\r\n]+")


def _lines(text: str):
    return [(m.start(), m.group()) for m in _BREAK.finditer(text)]


def _find(weights, redact: bool):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        model = SemiCRF(dict(weights))
        for batch in batches:
            texts = batch.column(1)
            lines = pc.split_pattern_regex(texts, r"[\r\n]")
            flat, owner = lines.flatten(), pc.list_parent_indices(lines)
            wide = pc.match_substring_regex(flat, WIDE_CLASS)
            flat = pc.replace_with_mask(flat, wide, pa.array([x.translate(WIDE) for x in flat.filter(wide).to_pylist()], flat.type))
            gates = open_gates(flat)
            wanted = np.flatnonzero(gates)
            sizes = pc.add(pc.utf8_length(flat), 1).to_numpy()
            ends = np.cumsum(sizes)
            own = owner.to_numpy()
            first: dict[int, int] = {}
            for i, o in enumerate(own.tolist()):
                if o not in first:
                    first[o] = int(ends[i] - sizes[i])
            found: dict[int, list] = {}
            for i, line in zip(wanted.tolist(), flat.take(pa.array(wanted)).to_pylist()):
                o = int(own[i])
                base = int(ends[i] - sizes[i]) - first[o]
                for c in model.decode(candidates(line, gates=int(gates[i]))):
                    found.setdefault(o, []).append((KINDS[c.kind], base + c.start, base + c.end))
            keys = batch.column(0)
            if redact:
                made = []
                for o, t in enumerate(texts.to_pylist()):
                    for kind, a, b in reversed(found.get(o, ())):
                        t = t[:a] + PLACEHOLDER[kind] + t[b:]
                    made.append(t)
                yield pa.RecordBatch.from_arrays([keys, pa.array(made, pa.string())], ["key", "text"])
            else:
                rows = [(o, *x) for o in sorted(found) for x in found[o]]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] + 1 for r in rows], pa.int64()), pa.array([r[3] - r[2] for r in rows], pa.int32())],
                    ["key", "kind", "start_pos", "length"],
                )

    return run


def find(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, kind, start_pos, length)``: each item once at every place, positions from 1.

    Null and empty texts hold no item. Repeated keys keep their rows.
    """
    t = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t")).where(F.length("t") > 0)
    kind = dict(df.dtypes)[key]
    return t.mapInArrow(_find(trained_weights(), False), f"key {kind}, kind string, start_pos bigint, length int").withColumnRenamed("key", key)


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text)`` with every item replaced by the placeholder of its type; null stays null."""
    t = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"))
    kind = dict(df.dtypes)[key]
    return t.mapInArrow(_find(trained_weights(), True), f"key {kind}, text string").withColumnsRenamed({"key": key, "text": text})
