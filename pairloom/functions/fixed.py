"""Word lists and rule tables whose entries and order decide results."""

# Words dropped by the first cleaner, case matters.
CLEAN_STOPS = [
    "the", "a", "an", "and", "but", "if", "or", "because", "as", "what", "which", "this", "that", "these", "those", "then",
    "just", "so", "than", "such", "both", "through", "about", "for", "is", "of", "while", "during", "to", "What", "Which",
    "Is", "If", "While", "This",
]

# English stop words of the shared-word measures.
ENGLISH_STOPS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's
her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren
weren't won won't wouldn wouldn't
""".split()

# Rules common to the first two cleaners, in order.
CLEAN_RULES = [
    (r"'s", " "),
    (r"'ve", " have "),
    (r"can't", "cannot "),
    (r"n't", " not "),
    (r"I'm", "I am"),
    (r" m ", " am "),
    (r"'re", " are "),
    (r"'d", " would "),
    (r"'ll", " will "),
    (r"60k", " 60000 "),
    (r" e g ", " eg "),
    (r" b g ", " bg "),
    (r"\x00s", "0"),
    (r" 9 11 ", "911"),
    (r"e-mail", "email"),
    (r"\s{2,}", " "),
    (r"quikly", "quickly"),
    (r" usa ", " America "),
    (r" USA ", " America "),
    (r" u s ", " America "),
    (r" uk ", " England "),
    (r" UK ", " England "),
    (r"india", "India"),
    (r"switzerland", "Switzerland"),
    (r"china", "China"),
    (r"chinese", "Chinese"),
    (r"imrovement", "improvement"),
    (r"intially", "initially"),
    (r"quora", "Quora"),
    (r" dms ", "direct messages "),
    (r"demonitization", "demonetization"),
    (r"actived", "active"),
    (r"kms", " kilometers "),
    (r"KMs", " kilometers "),
    (r" cs ", " computer science "),
    (r" upvotes ", " up votes "),
    (r" iPhone ", " phone "),
    (r"\x00rs ", " rs "),
    (r"calender", "calendar"),
    (r"ios", "operating system"),
    (r"gps", "GPS"),
    (r"gst", "GST"),
    (r"programing", "programming"),
    (r"bestfriend", "best friend"),
    (r"dna", "DNA"),
    (r"III", "3"),
    (r"the US", "America"),
    (r"Astrology", "astrology"),
    (r"Method", "method"),
    (r"Find", "find"),
    (r"banglore", "Banglore"),
    (r" J K ", " JK "),
]
# The first cleaner blanks everything but ASCII letters and digits and drops the question word.
CLEAN_V1 = [(r"\?+\z", ""), (r",+\z", ""), (r"[^A-Za-z0-9]", " "), (r"what's", ""), (r"What's", ""), *CLEAN_RULES]
# The second cleaner keeps all characters.
CLEAN_V2 = [(r"\?+\z", ""), (r",+\z", ""), (r"what's", "what is"), (r"What's", "what is"), *CLEAN_RULES]
# The cleaner of the sequence models, after lower case and single blanks.
CLEAN_SEQUENCE = [
    (r"[^A-Za-z0-9^,!./'+-=]", " "),
    (r"what's", "what is "),
    (r"'s", " "),
    (r"'ve", " have "),
    (r"can't", "cannot "),
    (r"n't", " not "),
    (r"i'm", "i am "),
    (r"'re", " are "),
    (r"'d", " would "),
    (r"'ll", " will "),
    (r",", " "),
    (r"\.", " "),
    (r"!", " ! "),
    (r"/", " "),
    (r"\^", " ^ "),
    (r"\+", " + "),
    (r"-", " - "),
    (r"=", " = "),
    (r"'", " "),
    (r"([0-9]+)k", "$1000"),
    (r":", " : "),
    (r" e g ", " eg "),
    (r" b g ", " bg "),
    (r" u s ", " american "),
    (r"\x00s", "0"),
    (r" 9 11 ", "911"),
    (r"e - mail", "email"),
    (r"j k", "jk"),
    (r"\s{2,}", " "),
]
#: ASCII punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]"

# Endings of the Lancaster stemmer, reversed, with letters to cut, to add, and whether to go on.
LANCASTER = """
ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct.
hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3>
lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2.
ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b.
tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1.
yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s.
""".split()
