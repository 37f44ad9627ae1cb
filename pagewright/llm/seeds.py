"""Labelled sentences and abbreviations that the sentence model learns from (fixed values)."""

#: Before a name.
TITLE_ABBREVIATIONS = frozenset("mr mrs ms dr prof sgt lt capt col gen rev hon st mt ft messrs mme mlle mm m me sr sra srta dra dña exmo sig dott ing avv dhr mevr mw hr fr frl г гр проф ул пл пр им акад डॉ श्री प्रो د أ".split())
#: Before a number.
NUMBER_ABBREVIATIONS = frozenset("no nos fig figs tab tabs chap ch sec eq app vol pp p pg art arts nr abs s bd kap abb ziff pág págs pag núm num cap blz hfdst afb рис стр табл гл с jan feb mar apr jun jul aug sep sept oct nov dec okt dez ene abr ago dic".split())
#: Within a sentence, before any word.
MID_ABBREVIATIONS = frozenset("approx ca cca cf cfr vs env viz resp incl excl est bzw vgl bijv evtl ggf sog ex ej i.e e.g z.b d.h u.a o.a t.o.v p.ex p.ej т.е cu".split())
#: May also end a sentence.
END_ABBREVIATIONS = frozenset("etc a.m p.m ltd inc co corp plc u.k u.s e.u rd ave blvd yd ft ret jr usw u.s.w enz gmbh bv".split())
#: Written with blanks inside.
SPACED_ABBREVIATIONS = ("z. B.", "d. h.", "u. a.", "o. a.", "p. ex.", "p. ej.", "т. е.", "т. д.", "т. п.", "i. e.", "e. g.", "s. o.", "v. a.")

SEEDS = {
    "en": [
        "The ferry left early.", "Nobody had seen the key.", "Her notes were lost in the flood of 1987.", "Mr. Tolbert opened the gate.",
        "Dr. Amsel and Prof. Kirwan agreed at 4.30 p.m. near St. Hallow Bridge.", "Ms. Vane called.", "Did you call Mrs. Orme?", "What a storm!",
        "It rained; see Fig. 3.2 for the gauge.", "We sold nails, twine, wax, etc.", "They open at 9 a.m. every day.", "The train leaves at 7 p.m.",
        "“Stay back! Please!” cried the guard before dawn.", "He asked: “Where is it?”", "She wrote: “We are late.”", "“It creaks,” said Mr. Dunn, “and it leaks.”",
        "The sign said “closed…”", "Who put “No entry!” on the door?", "The so-called “Phase C.” was skipped.", "The clerk shouted, \"Is it full?\" and ran off.",
        "The label reads ‘… see sec. C.’ and no more.", "(The list names all 40 parts.)", "The lease (signed in 1950. Extended once.) stays with Ms. Reed.",
        "3. The lid must be tight.", "14. Keep the door shut.", "7. Doors open outward.", "No.", "Yes.", "Maybe.", "Order No. 17 is late.",
        "Lot No. 4 came from Bray & Sons Ltd. of the U.K. branch, as agreed.", "It weighs approx. 3.5 cu. ft. at most.", "Rates rose by 3.1 % (cf. Tab. 2) vs. 4.0 % before.",
        "Version 2.0.1 came out on 5 Oct. 2019.", "Send it to box.7@post.example.test by 8.15 a.m. please.", "The sum is 2,310.75 at a.example.test/v1.2/list.html now.",
        "It fell from 3.2 to .7 overnight.", "pH levels above 7.5 are fine.", "It paused... then it went on.", "They waited...", "Were they ready?!",
        "Points a) to c) hold; point d) does not.", "Ch. 4 treats locks, and chap. 5 treats keys.", "Lt. Ferris (ret.) lives at 12 Mill Rd. by the pond.",
        "They live near Mt. Arvo, i.e. far from Ft. Lorn.", "Sgt. Dunn slept.", "Gen. Hale and Capt. Orme met in St. Vane.", "The cord costs $ 1.50 per yd. at most.", "The firm is Hale & Co. in the north.", "He works for Dray Ltd.",
        "She moved to the U.S.", "The U.S. office closed.", "J. R. Hobart signed.", "See p. 14 and pp. 20 to 22.", "The manager left in 2014.", "It is worth 350.",
        "Was it cold?", "Halt!", "The crew (all five of them) slept.", "A new pump (see Fig. 4.) was added.", "“We will stay.”", "“Run!”",
        "The valve opened at once, and the pressure fell.", "Each of the boxes was weighed again.", "He wrote “It works.” on the wall.", "The box says “Top. Up.” in red.",
    ],
    "de": [
        "Der Kahn legte früh ab.", "Niemand fand den Schlüssel.", "Hr. Tolbert öffnete das Tor.", "Dr. Amsel kam am 3. Juni gegen 4.15 Uhr.", "Der 12. Brief fehlt.",
        "Am 2. 11. 1978 schloss das Werk.", "Die Rechnung beträgt 1.250,75 Taler.", "Das kostet ca. 3,5 Taler, d. h. zu wenig.", "Der Motor lief, z. B. bei 3,2 bar, ruhig.",
        "Siehe Nr. 4 bzw. Abs. 7 auf S. 12.", "„Stopp! Bitte!“ rief der Wirt und ging.", "Sie fragte: „Wo ist er?“", "Er sagte: „Wir warten.“", "Ist das Tor noch zu?", "Welch ein Sturm!",
        "Es gab Nägel, Seile usw. im Lager.", "Wir kauften Brot, Käse usw.", "Der Umbau (Beginn 1950. Ende offen.) ruht.", "Das Haus wurde 1931 gebaut.", "Frau Prof. Kirwan blieb.",
        "»Halt!« rief er laut.", "4. Die Klappe bleibt zu.", "Nein.", "Das alte Lager brannte im Winter 1902.",
    ],
    "fr": [
        "Le bac partit tôt.", "Personne ne vit la clé.", "M. Tolbert ouvrit la grille.", "Mme Amsel et MM. Kirwan sont partis.", "M. Vane a payé env. 3,5 écus, cf. p. 12, art. 4.",
        "Le Dr. Amsel est venu à 4 h 20, p. ex. par la route.", "Le chap. 3 parle des serrures, etc.", "La pompe no. 7 pèse 2,5 kg.", "« Arrêtez ! Vite ! » cria le passeur.",
        "Elle a dit : « Partons. »", "Il demanda : « Où est-il ? »", "La grille est-elle fermée ?", "Quelle tempête !", "Il partit en 1987.", "« C’est fini », dit-elle.", "Non.",
        "Le bac (construit en 1950. Refait deux fois.) est à quai.", "3. Fermez la porte.",
    ],
    "es": [
        "El barco salió temprano.", "Nadie vio la llave.", "El Sr. Tolbert abrió la reja.", "La Sra. Vane pagó 3,5 reales, p. ej. en la pág. 12.", "El Dr. Amsel llegó a las 4.20 con el núm. 7.",
        "«¿Quién es?», dijo la mujer.", "Ella dijo: «Vamos.»", "¿Está abierta la reja?", "¡Qué tormenta!", "¡Alto!", "Se cerró en 1987.", "No.", "—¿Quién va?", "Compraron sal, pan, etc.",
    ],
    "pt": [
        "O barco saiu cedo.", "Ninguém viu a chave.", "O Sr. Tolbert abriu o portão.", "A Dra. Amsel não veio às 4.20 horas.", "O Sr. Vane pagou 3,5 reis, p. ex. na pág. 12.",
        "O portão está aberto?", "Que tempestade!", "Fechou em 1987.", "«Pare! Já!» gritou o guarda.", "Ela disse: «Vamos.»", "“Pare! Já!” gritou o homem.", "Não.",
    ],
    "it": [
        "La barca partì presto.", "Nessuno vide la chiave.", "Il sig. Tolbert ha aperto il cancello.", "Il dott. Amsel è venuto alle 4.20 in punto.", "Il sig. Vane ha pagato 3,5 lire, cfr. pag. 12.",
        "Il cancello è aperto?", "Che tempesta!", "Chiuse nel 1987.", "«Ferma! Subito!» gridò il guardiano.", "Lei disse: «Andiamo.»", "“Ferma! Subito!” gridò l’uomo.", "No.",
    ],
    "nl": [
        "De boot vertrok vroeg.", "Niemand zag de sleutel.", "Dhr. Tolbert betaalde ca. 3,5 gulden, zie blz. 12.", "Dr. Amsel kwam o.a. om 4.20 uur.", "Is de poort open?", "Wat een storm!",
        "Hij sloot in 1987.", "„Stop! Meteen!” riep de wacht.", "“Stop! Meteen!” riep de man en vertrok.", "Zij zei: “Wij gaan.”", "Nee.", "Er was zout, brood enz. in huis.",
    ],
    "ru": [
        "Паром ушёл рано.", "Никто не видел ключа.", "Г. Толберт открыл ворота.", "В 1987 г. на ул. Мельничной была почта.", "Г. Вейн заплатил 3,5 рубля, т. е. почти 7 %.",
        "Ворота открыты?", "Закрыта ли дверь № 4?", "Какая буря!", "«Стой! Назад!» — крикнул матрос.", "Она сказала: «Пора.»", "Он спросил: «Где он?»", "И. П. Орлов ушёл.", "Нет.", "См. рис. 3 и табл. 4.", "Его построили в 1950 г. и закрыли.",
    ],
    "ja": [
        "船は朝早く出た。", "鍵は誰も見なかった。", "門は開いていますか？", "なんという嵐だ！", "「待て。動くな。」と船長が言った。", "第3条（1950年改定。）に従う。", "値は2.5％（表3を参照。）だった。",
        "型番はVer.2.0である。", "彼女は言った：「行こう。」", "荷物は全部で12個だった。", "『止まれ！』と叫んだ。", "いいえ。", "「帰ろう！」彼はそう言った。",
    ],
    "zh": [
        "船很早就开了。", "没有人看见钥匙。", "大门开着吗？", "好大的风！", "“站住！别动！”船长喊道。", "数值为2.5％（见表3。）左右。", "型号是Ver.2.0。", "她说：“我们走。”", "货物一共12件。", "不。", "他问：“在哪里？”",
    ],
    "ko": [
        "배는 일찍 떠났다.", "아무도 열쇠를 보지 못했다.", "7번 문은 열렸습니까?", "굉장한 폭풍이다!", "“서라! 당장!” 하고 선장이 외쳤다.", "값은 2.5%(표 3 참조)였다.", "그녀가 말했다: “가자.”", "1987년에 닫았다.", "아니요.",
    ],
    "ar": [
        "غادرت السفينة باكرا.", "لم ير أحد المفتاح.", "هل البوابة رقم 7 مفتوحة؟", "يا لها من عاصفة!", "بلغ المعدل 2.5 في المئة (انظر الشكل 3).", "«قف! حالا!» صاح الحارس.", "قالت: «هيا.»", "أغلق عام 1987.", "قال د. أمسل إن السفينة غادرت.", "وصل د. كروان متأخرا.", "كتب أ. فين الرسالة.", "لا.",
    ],
    "hi": [
        "नाव सुबह जल्दी चली।", "किसी ने चाबी नहीं देखी।", "क्या दरवाज़ा 7 खुला है?", "कैसा तूफ़ान!", "डॉ. अमसेल 4 बजे आए।", "औसत 2.5 प्रतिशत था (चित्र 3 देखें)।", "“रुको! अभी!” पहरेदार चिल्लाया।", "उसने कहा: “चलो।”", "नहीं।", "श्री. वेन आए।", "प्रो. किरवन चले गए।", "कहा डॉ. वेन ने।",
    ],
    "th": [
        "เรือออกแต่เช้า", "ไม่มีใครเห็นกุญแจ", "ประตูเปิดอยู่หรือ", "พายุแรงมาก", "อัตราคือ2.5เปอร์เซ็นต์", "สินค้ามีทั้งหมดสิบสองชิ้น", "เขาปิดร้านก่อนฝนตก", "เราจะไปพรุ่งนี้", "ของหนัก 3.5 กิโลกรัม", "ดูตาราง (หน้า 12) ก่อน", "ห้อง 14 ว่าง", "ใบรับรอง (ชุด 3) หาย",
    ],
}
