"""Sentences with known boundaries, by language: the fixed part of the boundary model's training set.

Each entry is one sentence; texts for training are made by putting entries after each other.
"""

SPACED = {
    "en": [
        "Dr. Miller met Mrs. Hall at St. Mary's Church on Friday.",
        "The results, cf. Fig. 3 and Tab. 2, differ by approx. 4.5 percent.",
        "He works for Brown Inc. and she runs Smith Ltd. with two partners.",
        "Bring pens, paper, etc. and wait outside.",
        "We sell apples, pears, plums, etc.",
        "The train leaves at 5 p.m. sharp.",
        "The shop opens at 9 a.m.",
        "They arrived at 11 p.m.",
        "The U.S. army and the E.U. council agreed, i.e. they signed.",
        "See vol. 2, pp. 14 to 19, esp. No. 7 of the list.",
        "Mr. J. R. Stone wrote it.",
        "A. B. Carter read it twice.",
        "Version 2.10.3 fixes main.py and setup.cfg today.",
        "Well... Peter never said that.",
        "Hmm... Anna may be right.",
        "They waited for many long hours in the rain... Then it stopped.",
        "Is it ready?!",
        "What a day!",
        "Who is there?",
        "It costs 3.50 now.",
        "She was born in 1984.",
        "The box weighs 5 oz. and holds 3 qt. of milk.",
        "Prof. Gray vs. Capt. Wood was fun, e.g. for us.",
        "Sgt. Lee and Gen. Park left for Ft. Worth in Dec. or Jan. of that year.",
        "He asked for plan B.",
        "The answer is no.",
        "Sales grew from 12.5 to 19.75 percent.",
        "Ms. Young lives on Elm St. near the park.",
        "Rev. Black et al. disagree.",
        "The cat sat on the mat.",
        '"The house is old."',
        '"We leave at noon!"',
        'They call it "the end."',
        "It fits Tom (a big one!).",
        "They left (at last).",
        "We saw it (who did not?).",
        "Nobody knew the way home.",
        '"Who is there? I am coming!" called Max.',
        "The list was made by Ian.",
        "Give the rest to Amy.",
        "Some words are never found.",
        "It compares the list with No. 12 of the set.",
        "Stone Co. bought Hill Corp. last year.",
        "The N.A.S. group kept most of it.",
        "Lena belongs to the team.",
        "The word list comes from Tom.",
        "All of this is according to Rita.",
    ],
    "de": [
        "Dr. Weber und Prof. Klein kommen morgen.",
        "Am 3. Mai war das Haus leer.",
        "Der 2. Versuch am 14. Juni gelang.",
        "Sie kommt am 7. mit dem Zug, evtl. auch eher.",
        "Er nutzt z. B. ein Buch, d. h. eine Quelle mit 12,5 Seiten.",
        "Siehe Nr. 8 bzw. Abs. 4 bei Meier!",
        "Das kostet ca. 3.500 Euro inkl. Versand, vgl. S. 9.",
        "Laut Hr. Bauer sind u. a. Listen, Karten usw. weg.",
        "Ist das wahr?",
        "Die Frist endet am 1. Oktober.",
        "Im 19. Jahrhundert lebte er in der Bahnhofstr. 5.",
        "Niemand kennt den Weg.",
        "„Wer ist da? Ich komme!“, rief Uwe.",
        "Das Buch gehört Ute.",
        "Morgen fährt Max.",
        "Alles liegt bei Ida.",
        "Sie blieb (wie immer).",
        "Das Register ist neu.",
        "„Das Haus ist alt.“",
        "Man nennt es „das Ende.“",
        "Das Kind schläft schon.",
        "Fr. Lang und Frl. Kurz wohnen ggf. dort.",
        "Es gab Brot, Käse usw.",
        "Das war im Jahr 1990.",
        "Er nahm Nummer 12.",
    ],
    "fr": [
        "M. Petit et Mme Roux arrivent demain.",
        "M. Blanc a lu la p. 8 du livre, cf. le vol. 3.",
        "Cf. le texte de Mlle Noir, éd. 2, vol. 4 !",
        "Elle range les mots, les listes, etc. dans un tiroir.",
        "Il y a des pommes, des poires, etc.",
        "Est-ce que tu viens ?",
        "Quel beau livre !",
        "« La maison est vieille. »",
        "Le prix passe de 3,5 à 4,25 selon Luc.",
        "Le Dr. Martin habite av. Foch.",
        "Je ne sais pas.",
        "Il part (enfin !).",
        "Eh bien... Paul ne dit rien.",
        "On le trouve à la p. 12 du cahier.",
        "Il est né en 1970.",
        "« Qui est là ? J'arrive ! » cria Max.",
        "Le livre est à Zoé.",
        "La réponse est ici.",
    ],
    "es": [
        "El Sr. Gil y la Sra. Paz llegan hoy.",
        "La Dra. Ruiz cita el libro, pág. 4, etc. en su obra.",
        "El Dr. Mora pagó 3,5 por el libro n.º 12.",
        "Vive en EE. UU. desde enero, según Ud. dijo.",
        "¿Quién es usted?",
        "¡Qué bonito!",
        "«La casa es vieja.»",
        "Según Eva, el texto tiene 12.345 palabras.",
        "Compró pan, leche, etc.",
        "No lo sé.",
        "Se fue (¡por fin!).",
        "Pues... Juan nunca vino.",
        "Nació en 1975.",
        "«¿Quién es? Ya voy.», gritó Max.",
        "El libro es de Leo.",
        "Ana perdió el libro otra vez.",
        "Véase el cap. 3, vol. 2 y la fig. 5 del Prof. Sanz.",
    ],
    "ko": [
        "나는 학교에 간다.",
        "비율은 3.5이고 둘째 줄에 있다.",
        "벌써 읽었나요?",
        "정말 좋다!",
        "v2.1 판에서 항목이 바뀌었습니다.",
        "그는 밥을 먹었다.",
        "Smith는 집에 있다.",
    ],
    "hi": [
        "डॉ. शर्मा ने कहा कि घर छोटा है।",
        "यह पाठ पृ. 12 पर है।",
        "क्या आपने 3.5 अंक पाए?",
        "वाह, बहुत अच्छा!",
        "श्री. वर्मा और कु. गीता आए।",
        "राम ने किताब खोली।",
        "डॉ. Smith ने कहा कि सूची बड़ी है।",
    ],
}
JOINED = {
    "ja": [
        "まあ…彼なら仕方がない。",
        "本当ですか！？",
        "第2.3節を見よ。",
        "これはNo.5からNo.9までです。",
        "手紙が届いた．",
        "どこへ行くの？",
        "v1.2.3では順が変わる。",
        "円周率は3.14である。",
        "やった！",
    ],
    "zh": ["唉……他也没有。", "真的吗？！", "比例是3.5，第2行有误。", "我走了。", "好极了！", "这是第2.1版。"],
}
