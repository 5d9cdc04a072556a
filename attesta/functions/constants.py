"""Versioned values, to be read and not tuned."""

MASK_CHAR = "\ue000"
MAX_CHUNK, MAX_OVERLAP = 1200, 160
BM25_K1, BM25_B = 1.2, 0.75
TOP_K, FUSION_K, FUSION_DEPTH = 10, 60, 100
CHUNKER_POLICY, INDEX_FORMAT_VERSION = "v2", 1
MIN_LEXICAL_SUPPORT, MARGIN = 0.25, 1.25
COALESCE_MAX, MIN_CLUSTER, GRANULARITY = 80, 70, "cluster"
MINIMUM_NORM = 1e-12
OVERLAP_THRESHOLD = 0.5
MIN_SCORED_CITATIONS, MAX_UNMATCHED_RATIO = 100, 0.1
MIN_USABLE_LETTERS = 60
TOKENIZER_PLAIN, TOKENIZER_STEMMED = "standard+no-stemmer", "standard+rslp-s-folded"

# Words that negate, folded.
NEGATION_MARKERS = ("nao", "nunca", "jamais", "nenhum", "nenhuma", "ninguem", "nada", "nem", "sem")

# Portuguese abbreviations after which a period ends no sentence before a capital or a
# digit (the non-breaking prefix list of the Moses toolkit, by way of NLTK; Apache-2.0).
ABBREVIATIONS = frozenset(
    """
    A B C D E F G H I J K L M N O P Q R S T U V W X Y Z a b c d e f g h i j k l m n o p q r s t u v w x y z
    I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX
    i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx
    Adj Adm Adv Art Ca Capt Cmdr Col Comdr Con Corp Cpl DR DRA Dr Dra Dras Drs Eng Enga Engas Engos Ex Exo Exmo Fig
    Gen Hosp Insp Lda MM MR MRS MS Maj Mrs Ms Msgr Op Ord Pfc Ph Prof Pvt Rep Reps Res Rev Rt Sen Sens Sfc Sgt Sr Sra
    Sras Srs Sto Supt Surg adj adm adv art cit col con corp cpl dr dra dras drs eng enga engas engos ex exo exmo fig op
    prof sr sra sras srs sto v vs i.e rev e.g Nos Nr
    """.split()
)
# Those of which the period ends no sentence only before a digit.
NUMERIC_ABBREVIATIONS = frozenset(("No", "Art", "p", "pp"))

# Plural rules in order, as (ending, what replaces it, letters before it at least, words it spares).
PLURAL_RULES = (
    ("ns", "m", 1, ()),
    ("oes", "ao", 3, ()),
    ("aes", "ao", 1, ("maes",)),
    ("ais", "al", 1, ("cais", "mais", "pais")),
    ("eis", "el", 2, ()),
    ("ois", "ol", 2, ("depois",)),
    ("is", "il", 2, ("lapis", "cais", "mais", "crucis", "biquinis", "pois", "depois", "dois", "leis", "pais")),
    ("les", "l", 3, ()),
    ("res", "r", 3, ("arvores",)),
    ("s", "", 2, ("alias", "pires", "lapis", "cais", "mais", "mas", "menos", "ferias", "fezes", "pesames", "crucis", "gas", "atras", "moises", "atraves", "conves", "es", "pais", "apos", "ambas", "ambos", "messias", "depois", "dois")),
)
