"""Hand-made cases: one list of inputs and spoken forms for each rule, and small lexicons for the phonemes.

Each rule is applied alone, so what a case shows is that rule and not the chain around it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loquat.functions import numbers as N
from loquat.operators import normalize as R
from loquat.sources.lexicon import common, merged

RULES = {
    "n2w": (N.n2w, [("0", "không"), ("007", "bảy"), ("05", "không năm"), ("00", "không không"), ("1000000000000", "một nghìn tỷ"), ("1000000000000000000", "một tỷ tỷ"), ("a1", "a1"), ("10015", "mười nghìn không trăm mười lăm")]),
    "n2w_hundreds": (N.n2w, [("101", "một trăm lẻ một"), ("115", "một trăm mười lăm"), ("221", "hai trăm hai mươi mốt"), ("10", "mười"), ("55", "năm mươi lăm")]),
    "n2w_single": (N.n2w_single, [("+84912", "không chín một hai"), ("090-1", "không chín không một"), ("x", "x")]),
    "n2w_decimal": (N.n2w_decimal, [("25", "hai lăm"), ("05", "không năm"), ("5", "năm"), ("155", "một năm lăm"), ("50", "năm không")]),
    "each_digit": (N.each_digit, [("0915", "không chín một năm")]),
    "plain_number": (lambda t: N.plain_number(t, F.lit(True)), [("1.000", "âm một nghìn"), ("2.50", "âm hai chấm năm không"), ("3,25", "âm ba phẩy hai lăm"), ("1 000", "âm một nghìn")]),
    "quantity": (N.quantity, [("1,299", "một nghìn hai trăm chín mươi chín"), ("2.50", "hai chấm năm"), ("8,92", "tám phẩy chín hai"), ("1,299.50", "một nghìn hai trăm chín mươi chín phẩy năm"), ("1.299,5", "một nghìn hai trăm chín mươi chín phẩy năm"), ("3,00", "ba")]),
    "scientific_notation": (R.scientific_notation, [("3.2e5", "ba chấm hai nhân mười mũ năm"), ("1e-3", "một nhân mười mũ trừ ba"), ("2,50E+4", "hai phẩy năm nhân mười mũ bốn")]),
    "explicit_power": (R.explicit_power, [("1.5×10^-3", " 1.5 nhân mười mũ trừ ba "), ("2 x 10^6", " 2 nhân mười mũ sáu ")]),
    "context_minus": (R.context_minus, [("tính 5 - 3", " tính 5 trừ 3 "), ("5 - 3 bằng", " 5 trừ 3 bằng "), ("từ 5 - 3", " từ 5 đến 3 ")]),
    "dashed_phone": (R.dashed_phone, [("090-123-4567", " không chín không một hai ba bốn năm sáu bảy "), ("0912-345-67", "0912-345-67")]),
    "implicit_power": (R.implicit_power, [("10^9", "mười mũ chín"), ("10^-2", "mười mũ trừ hai"), ("110^2", "110^2")]),
    "abbreviations": (R.abbreviations, [("v.v", " vân vân"), ("v/v", " về việc"), ("đ/c A", "địa chỉ A")]),
    "full_date": (R.full_date, [("21/02/2025", "ngày hai mươi mốt tháng hai năm hai nghìn không trăm hai mươi lăm"), ("01-04.2024", "ngày một tháng tư năm hai nghìn không trăm hai mươi bốn"), ("31/02/2025", "31/02/2025")]),
    "month_year": (R.month_year, [("04/2024", "tháng tư năm hai nghìn không trăm hai mươi bốn"), ("13/2024", "tháng mười ba năm hai nghìn không trăm hai mươi bốn")]),
    "day_month": (R.day_month, [("30/4", "ngày ba mươi tháng tư"), ("29/2", "ngày hai mươi chín tháng hai"), ("32/01", "32/01"), ("1.5", "1.5")]),
    "no_double_words": (R.no_double_words, [("ngày  ngày mai", "ngày mai"), ("năm năm", "năm")]),
    "full_time": (R.full_time, [("08:05:00", "không tám giờ không năm phút không giây"), ("1h2m3s", "một giờ hai phút ba giây")]),
    "clock_time": (R.clock_time, [("8h05", "tám giờ không năm phút"), ("27:45", "hai mươi bảy phút bốn mươi lăm giây"), ("8:75", "8:75"), ("27h45 phút", "hai mươi bảy giờ bốn mươi lăm phút")]),
    "hours": (R.hours, [("8g sáng", "tám giờ sáng"), ("lúc 10g", "lúc mười giờ"), ("8g", "8g")]),
    "number_range": (R.number_range, [("10-20", " 10 đến 20 "), ("1-2000", " 1 2000 "), ("5 -3", "5 -3"), ("1,5 - 2,5", " 1,5 đến 2,5 ")]),
    "dashes_and_arrows": (R.dashes_and_arrows, [("a - b", "a , b"), ("a -> b", "a sang b"), ("a=>b", "a sang b")]),
    "compound_units": (R.compound_units, [("60km/h", "sáu mươi  ki lô mét trên giờ "), ("3 M/m", "ba  triệu trên mét "), ("km/h", "km/h")]),
    "measured": (R.measured, [("5kg", "năm ki lô gam"), ("2 triệu m", "hai triệu mét"), ("3M", "ba triệu"), ("1,5 KM2", "một phẩy năm ki lô mét vuông")]),
    "bare_units": (R.bare_units, [("mấy km", "mấy  ki lô mét "), ("km3", "km3")]),
    "prefix_currency": (R.prefix_currency, [("$50", "năm mươi __start_en__u s d__end_en__"), ("£1,5 triệu", "một phẩy năm triệu __start_en__pound__end_en__")]),
    "suffix_currency": (R.suffix_currency, [("100¥", "một trăm yên"), ("100 ¥", "100 ¥")]),
    "percent": (R.percent, [("12,50 %", "mười hai phẩy năm phần trăm")]),
    "english_numbers": (R.english_numbers, [("1,299.5", "1299,5"), ("1,299,495", "1299495"), ("1,299", "1,299")]),
    "many_commas": (R.many_commas, [("1,23,4", "một phẩy hai ba phẩy bốn")]),
    "comma_numbers": (R.comma_numbers, [("4.200,5", " bốn nghìn hai trăm phẩy năm "), ("3,0", " ba "), ("2,5%", " hai phẩy năm phần trăm ")]),
    "dotted_thousands": (R.dotted_thousands, [("45.565", "45565"), ("1.5", "1.5")]),
    "exceptions": (R.exceptions, [("TP.HCM và JSON", "thành phố hồ chí minh và __start_en__j son__end_en__"), ("XTP", "XTP")]),
    "slashes": (R.slashes, [("32/01", "ba mươi hai xẹt không một"), ("1/2", "một trên hai")]),
    "suffixes": (R.suffixes, [("a.com", "a chấm com"), ("b.ORG", "b chấm o rờ gờ"), ("a.community", "a.community")]),
    "roman": (R.roman, [("XXI", " hai mươi mốt "), ("MCMXCIV", " một nghìn chín trăm chín mươi bốn "), ("IIII", "IIII"), ("I", "I")]),
    "letter_names": (R.letter_names, [("chữ 'B'", "chữ bê '"), ("ký tự x", "ký tự ích ")]),
    "digits_letter": (R.digits_letter, [("8x", "8 ích"), ("12B", "12 bê"), ("3ab", "3ab")]),
    "primes": (R.primes, [("A'", "a phẩy"), ("1’", "một phẩy"), ("a'b", "a'b")]),
    "unit_powers": (R.unit_powers, [("mol^-1", " mol mũ trừ một "), ("m^2", " mét mũ hai "), ("x^3", " x mũ ba ")]),
    "quotes_and_symbols": (R.quotes_and_symbols, [("“a” & b", "a  và  b"), ("'a'", " a "), ("1 ≥ 0", "1  lớn hơn hoặc bằng  0")]),
    "brackets_and_degrees": (R.brackets_and_degrees, [("a (b)", "a , b, "), ("-5°C", "âm 5 độ xê"), ("30 ° f", "30 độ ép"), ("45°", "45 độ ")]),
    "acronyms": (R.acronyms, [("dùng ABC", "dùng __start_en__a b c__end_en__"), ("có NASA", "có __start_en__nasa__end_en__"), ("xe A4", "xe a bốn"), ("ABC DEF", "ABC DEF"), ("ABC. dùng AB", "ABC. dùng __start_en__a b__end_en__")]),
    "versions": (R.versions, [("1.2.10", "một chấm hai chấm một không"), ("1.2", "1.2")]),
    "colon_numbers": (R.colon_numbers, [("9001:2015", " chín nghìn không trăm lẻ một hai chấm hai nghìn không trăm mười lăm ")]),
    "only_known_characters": (R.only_known_characters, [("a: b; c§", "a, b, c "), ("ẹ漢", "ẹ ")]),
    "ordinals": (R.ordinals, [("thứ 4", "thứ tư"), ("Hạng 1", "Hạng nhất"), ("thứ 21", "thứ hai mươi mốt")]),
    "products": (R.products, [("3x4", "ba nhân bốn"), ("3 x 4", "ba nhân bốn")]),
    "phones": (R.phones, [("0912345678", "không chín một hai ba bốn năm sáu bảy tám"), ("+84912345678", "không chín một hai ba bốn năm sáu bảy tám")]),
    "numbers": (R.numbers, [("-5", " âm năm "), ("a 1.000", "a  một nghìn "), ("a-5", "a -năm "), ("(-2.5", "( âm hai chấm năm ")]),
    "single_letters": (R.single_letters, [("B.", " bê "), ("b.", " bê. "), ("a'b", " a 'b")]),
    "inner_dots": (R.inner_dots, [("1.2.3", "1 chấm 2 chấm 3")]),
    "tidy": (R.tidy, [(" a  ,, b ,. c ", "a, b. c"), ("x.Y", "x. Y"), (",a,", " a"), ("a...b", "a. . . b")]),
    "plain_tags": (R.plain_tags, [("__start_en__a__end_en__ b_c-d", "<en>a</en> b c d")]),
    "compose": (R.compose, [("a\u0302\u0323", "ậ"), ("a\u0323\u0302", "ậ"), ("e\u0323\u0302t", "ệt"), ("abc", "abc")]),
    "compose_all_scripts": (R.compose, [("\u212b\u2126", "ÅΩ"), ("и\u0306", "й"), ("\u0ba9\u0bbe", "\u0ba9\u0bbe"), ("\u0bc6\u0bbe", "\u0bca"), ("x\u0301\u0323", "x\u0323\u0301"), ("a\u0315\u0301", "á\u0315"), ("\u0958", "\u0915\u093c"), ("e\u0301\u0301", "é\u0301"), ("ɛ\u0302\u0323", "ɛ\u0323\u0302"), ("漢字", "漢字"), ("𝅗𝅥", "\U0001d157\U0001d165")]),
    "ascii_digits": (R.ascii_digits, [("١٢/٠٣/٢٠٢٤", "12/03/2024"), ("８:３０", "8:30"), ("९५", "95"), ("²½Ⅳ", "²½Ⅳ"), ("a1", "a1"), ("𝟗𝟘", "90")]),
    # Digits of other scripts alone leave a rule without a match; the chain brings them to 0-9 first (``foreign_digits``).
    "dates_of_other_digits": (lambda t: R.slashes(R.day_month(R.month_year(R.full_date(t)))), [("١٢/٠٣/٢٠٢٤", "١٢/٠٣/٢٠٢٤"), ("１２/３", "１２/３"), ("1٢/3", "1٢/3")]),
    "times_of_other_digits": (lambda t: R.clock_time(R.full_time(t)), [("٨:٣٠", "٨:٣٠"), ("８h０５", "８h０５")]),
    "foreign_digits": (lambda t: R.clock_time(R.full_date(R.ascii_digits(t))), [("١٢/٠٣/٢٠٢٤", "ngày mười hai tháng ba năm hai nghìn không trăm hai mươi bốn"), ("８:３０", "tám giờ ba mươi phút")]),
    # One row for each quirk that is kept on purpose: lone acronyms as sentences (Q6), words that are roman numbers (Q7),
    # hyphenated words as technical names (Q9), "and/or" as a compound unit (Q10).
    "quirk_q6_lone_acronym": (R.acronyms, [("AI", "AI"), ("AI là", "__start_en__a i__end_en__ là")]),
    "quirk_q7_roman_words": (R.roman, [("MIX", " một nghìn không trăm lẻ chín "), ("CD", " bốn trăm "), ("CV", " một trăm lẻ năm ")]),
    "quirk_q9_hyphens": (R.technical, [("a-b-c", "__start_en__a__end_en__ gạch ngang __start_en__b__end_en__ gạch ngang __start_en__c__end_en__")]),
    "quirk_q10_and_or": (R.compound_units, [("3 and/or 4", "ba  and trên or  4")]),
    "technical": (R.technical, [("https://a.com/x", "__start_en__https__end_en__ __start_en__a__end_en__ chấm com gạch __start_en__x__end_en__"), ("/usr/bin", "gạch __start_en__usr__end_en__ gạch __start_en__bin__end_en__"), ("C:\\d1", "__start_en__c__end_en__ hai chấm gạch __start_en__d__end_en__ một"), ("a..-vn", "__start_en__a__end_en__ chấm __start_en__v n__end_en__")]),
    "email": (R.email, [("a.b1@gmail.com", "__start_en__a__end_en__ chấm __start_en__b__end_en__ một a còng __start_en__gmail__end_en__ chấm com"), ("x_20@q-r.vn", "__start_en__x__end_en__ gạch dưới hai mươi a còng __start_en__q__end_en__ gạch ngang __start_en__r__end_en__ chấm __start_en__v n__end_en__")]),
}

# Phonemes here are recognisably synthetic. The pairs of PROPAGATION and the texts of PIPELINE are fixed values: results
# must agree on them.
SMALL_LEXICON = [
    *(merged(w, f"vi-{w}") for w in ("muốn", "tôi", "mua", "một", "cái", "túi", "ăn", "quả", "cho", "ngăn")),
    *(merged(w, f"en-{w}", True) for w in ("market", "hello", "say", "give", "it", "do", "book", "case")),
    *(common(w, f"vi-{w}", f"en-{w}") for w in ("go", "to", "the", "me", "no", "can", "i", "a")),
    *(merged(w, f"en-{w}", True) for w in ("ab", "abc", "cde", "de", "b")),
]
PROPAGATION = [
    ("Tôi muốn go to the market", "Tôi muốn <en>go to the market</en>"),
    ("go to the market. Mua một cái túi to.", "<en>go to the market</en>. Mua một cái túi to."),
    ("cái túi to market", "cái túi to <en>market</en>"),
    ("muốn go to market", "muốn <en>go to market</en>"),
    ("hello give it to me", "hello <en>give it to me</en>"),
    ("ăn quả me", "ăn quả me"),
    ("hello I say no", "hello <en>I say no</en>"),
    ("ăn cho no", "ăn cho no"),
    ("I can do it", "<en>I can do it</en>"),
    ("can ngăn", "can ngăn"),
    ("hello no, no, no", "hello <en>no, no, no</en>"),
    ("ăn no, a túi, to market", "ăn no, a túi, <en>to</en> market"),
]
SEGMENTS = [
    ("bookcase", "en-book en-case"),
    ("abcde", "en-ab en-cde"),
    ("xyz", "xyz"),
    ("bz", "en-bz"),
    ("<en>Bookmarket!</en>", "en-book en-market!"),
    ("", ""),
]
PIPELINE = [
    ("A'", ["fˈəɪ4"]),
    ("1'", ["mˈo6t̪ fˈəɪ4"]),
    ("I don't care", ["dˈoʊnt"]),
    ("It's a gift", ["ɪts"]),
    ("Giá SP500 hôm nay là 4.200,5 điểm", ["zˈaː", "nˈam", "tʃˈam", "fˈəɪ4", "ɗˈiɛ"]),
]
