"""Word lists and letter tables that results depend on. They are data, stated as text in their natural order."""

from __future__ import annotations

# English stop words
STOP_EN = """
    a about above after again against all am an and any are aren't as at be because been before being below between both but by can cannot could couldn't
    did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he her here hers herself him
    himself his how i if in into is isn't it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out
    over own same she should shouldn't so some such than that the their theirs them themselves then there these they this those through to too under until
    up very was wasn't we were weren't what when where which while who whom why will with won't would wouldn't you your yours yourself yourselves
""".split()

# Chinese stop words
STOP_ZH = """
    一 一个 上 下 不 与 且 为 之 也 了 于 什么 从 他 以 们 会 但 你 其 则 到 又 只 可以 向 和 因为 在 地 她 如果 它 对 就 很 得 怎么 我 或 所以 把 是 更 最 有 没 的 着 给 而 能 被 让 过 还 这 这个 那 那个 那么 都
""".split()

# Japanese stop words
STOP_JA = """
    あの ある あれ いる か から が こと この これ しか しかし した する そして その それ ため だ だけ で です でも と どの どれ な など に ね の は へ ます また まで も もの や よ よう より わ を
""".split()

# Korean stop words
STOP_KO = """
    가 것 과 그 그러나 그리고 까지 는 대해 도 되다 등 때문 또 로 를 만 무엇 및 부터 수 어떤 없다 에 에게 에서 와 위해 으로 은 을 의 이 이다 있다 저 하다 하지만
""".split()

# Thai words that end a sentence
ENDERS = """
    กัน ขึ้น ครับ คะ ค่ะ จริงๆ จ้ะ จ้า จ๋า ด้วย ทำไม ทีเดียว นะ นะคะ นั้น นี้ น้อย บ้าง มั้ย มา มาก ยังไง ลง หมด หรือไม่ อยู่ อย่างไร อะไร อีก ฮะ เช่นกัน
    เดียว เท่านั้น เมื่อไร เมื่อไหร่ เลย เหล่านั้น เหล่านี้ เอง แล้ว ใหม่ ได้ ไป ไว้ ไหน ไหม ๆ
""".split()

# Thai words that begin a sentence
STARTERS = """
    กับ กู ก็ ข้าพเจ้า คุณ ฉะนั้น ฉัน ชั้น ซึ่ง ดังนั้น ดิฉัน ด้วย ตอนนี้ ตั้งแต่ ต่อ ถ้า ทีนี้ นั้น นี้ ผม พวกเขา พวกเรา มัน มึง หรือ เขา เค้า เธอ
    เนื่องจาก เพราะ เพราะฉะนั้น เมื่อ เรา เหล่านั้น เหล่านี้ แก แก่ แต่ และ ใน ในที่สุด ไม่
""".split()

# Thai sentence-final particles
PARTICLES = """
    ครับ ค่ะ คะ ขา จ้ะ จ้า จ๊ะ จ๋า ค่า นะ น่ะ นะคะ นะครับ ล่ะ ล่ะครับ สิ ซิ หรอก หรอกนะ เลย เนอะ เน้อ แหละ นั่นแหละ นี่แหละ ด้วย ก็ได้ เถอะ เถิด แล้วกัน
    ครับผม แล้ว ว่า ไหม มั้ย หรือ รึ หรือเปล่า หรือไม่ ป่ะ ปะ ไย ฤๅ เล่า หนอ วะ ว่ะ โว้ย เว้ย เฟ้ย ยะ อ่ะ เฮ้ย โอ้ย ฮึ ฮ่า อือ อ้อ เพคะ พ่ะย่ะค่ะ
    พระพุทธเจ้าข้า พระเจ้าข้า เจ้าค่ะ เจ้าขา ขอรับ ขอรับกระผม มิได้ ดอก แล นะเจ้าคะ เสียแล้ว เสียจริง เสียนี่ นั่นเอง นี่เอง เท่านั้น เท่านั้นเอง
    ก็เป็นได้ ก็แล้วกัน มิใช่หรือ เช่นนั้นหรือ กระนั้น ยิ่งนัก นักแล กระมัง เจียว หนา นั่นเทียว หามิได้ ก็หาไม่ นั่นแล สินะ ล่ะนะ ด้วยล่ะ นั่นล่ะ งั้นหรือ
    นั่นสินะ ล่ะสิ เอย เฮย นา รา เทอญ เอ๋ย ฉะนี้ ฉะนั้น ดังนี้ ดังนี้แล ฉะนั้นแล ด้วยเทอญ
""".split()

# Thai words that fill a query
FILLER = """
    ครับ ค่ะ คะ ค่า ขา จ้ะ จ้า จ๊ะ จ๋า ฮะ ฮ่ะ ครับผม นะ น่ะ นะคะ นะครับ ล่ะ สิ ซิ หน่อย ได้ ไหม มั้ย ไง ยังไง อย่างไร บ้าง รึ หรือเปล่า รึเปล่า ไหน อะไร
    ทำไม เท่าไหร่ เท่าไร หรอ เหรอ ป่ะ ปะ ช่วย ขอ อยาก ต้องการ รบกวน วาน สรุป หา ค้นหา ดู เอา ติดต่อ สอบถาม ถาม แจ้ง บอก ทำ อยู่ เรื่อง เกี่ยว การ แบบ
    ประมาณ
""".split()

# Groups of forms that mean the same, the acronym first
ACRONYMS = """
IT ไอที เทคโนโลยีสารสนเทศ
PC พีซี คอมพิวเตอร์
HR เอชอาร์ ทรัพยากรบุคคล ฝ่ายบุคคล
ACC บัญชี
FIN การเงิน ไฟแนนซ์
MKT การตลาด มาร์เก็ตติ้ง
ADMIN ธุรการ แอดมิน
POS พีโอเอส จุดขาย แคชเชียร์
OPS ปฏิบัติการ
QA คิวเอ ควบคุมคุณภาพ
SOP ขั้นตอนปฏิบัติงาน คู่มือ
"""

# Korean particles of several syllables
JOSA = """
    으로써 으로서 으로부터 에서부터 에게서 이라고 에서는 에게는 으로는 이라는 께서는 에서 에게 께서 한테 으로 이나 이란 이라 라도 든지 처럼 보다 마다 조차 밖에 부터 까지 마저 대로 이랑
""".split()

# Thai month names
MONTHS = """
    มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม ม.ค. ก.พ. มี.ค. เม.ย. พ.ค. มิ.ย. ก.ค. ส.ค. ก.ย. ต.ค.
    พ.ย. ธ.ค.
""".split()

# Thai honorifics
HONORIFICS = """
    นาย นาง นางสาว น.ส. ด.ช. ด.ญ. เด็กชาย เด็กหญิง ดร. ศ. รศ. ผศ. คุณ พล. พ.ต. ร.ต. พระ หม่อม
""".split()

# Letters and their sounds
UDOM_FIRST = (
    "กขฃคฅฆงจฉชฌซศษสฎดฏตฐฑฒถทธณนบปผพภฝฟมญยรลฬฤฦวอหฮ",
    "กขขขขขงจชชชสสสสดดตตททททททนนบปพพพฟฟมยยรรรรรวอฮฮ",
)

# Letters and their sounds
UDOM_REST = (
    "มวำกขฃคฅฆงยญณนฎฏดตศษสบปพภผฝฟหอฮจฉชซฌฐฑฒถทธรฤลฦ",
    "0001111112233344444445555666666777778888889999",
)

# Letters and their sounds
LK_FIRST = (
    "กขฃคฅฆงจฉชฌซศษสญยฎดฏตณนฐฑฒถทธบปผพภฝฟมรลฬฤฦวหฮอ",
    "กกกกกกงจชชชซซซซยยดดตตนนททททททบปพพพฟฟมรรรรรวหหอ",
)

# Letters and their sounds
LK_REST = (
    "กขฃคฅฆงจฉชซฌฎฏฐฑฒดตถทธศษสญณนรลฬฤฦบปพฟภผฝมำยวไใหฮาๅึืเแโุูอ",
    "1111112333333333333333333444444445555555667777889AAABCDEEF",
)
