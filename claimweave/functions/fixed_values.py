"""Word lists, patterns, weights and limits that results depend on.

Everything in this module is a constant that must hold exactly for results to be right;
no logic lives here. Larger vocabularies (taxonomies, ontologies, name lists) are tables
passed in by the caller.
"""

# --- Fixed values: lexicon of interaction terms, on lower-cased text -------------------------
STRONG_TERMS = [
    r"\bparasiti[zs]e[sd]?\b",
    r"\bparasiti[zs]ing\b",
    r"\bparasitic\s+on\b",
    r"\bparasite\s+of\b",
    r"\bectoparasite(?:\s+of)?\b",
    r"\bendoparasite(?:\s+of)?\b",
    r"\bhyperparasite(?:\s+of)?\b",
    r"\bparasitoid(?:\s+of)?\b",
    r"\bnematode\s*[- ]?parasit\w+\b",
    r"\bpreys?\s+(?:up)?on\b",
    r"\bpreyed\s+(?:up)?on\b",
    r"\bpredation\b",
    r"\bpredator\s+of\b",
    r"\binfect(?:s|ed|ing)\b",
    r"\binfected\s+(?:by|with)\b",
    r"\bpathogen\s+of\b",
    r"\bpathogenic\s+(?:to|for|in)\b",
    r"\bcausative\s+agent\s+of\b",
    r"\bcause[sd]?\s+infection\b",
    r"\bvector\s+of\b",
    r"\btransmit(?:s|ted|ting)\b",
    r"\btransmitted\s+by\b",
    r"\btransmission\s+of\b",
    r"\bwellestablished\s+vector\b",
    r"\bpollinat(?:es?|ed|ing)\b",
    r"\bpollinator\s+of\b",
    r"\bvisits?\s+(?:the\s+)?flowers?\s+(?:of|from)\b",
    r"\bfloral\s+visitor\b",
    r"\bdisperses?\s+seeds?\s+of\b",
    r"\bseed\s+dispers(?:al|es?)\b",
    r"\bfeeds?\s+on\b",
    r"\bfed\s+(?:on|foliage)\b",
    r"\bconsumes?\s+\w+",
    r"\bconsumed\s+by\b",
    r"\bhost\s+of\b",
    r"\bhost\s+to\b",
    r"\bhost\s+for\b",
    r"\bhashost\b",
    r"\bhost\s+range\b",
    r"\bserves?\s+as\s+(?:a\s+)?host\b",
    r"\buses?\s+\w+\s+as\s+(?:its\s+)?host\b",
    r"\bfound\s+on\s+host\b",
    r"\bsymbiont\s+of\b",
    r"\bmutualist\s+of\b",
    r"\bherbivore\s+of\b",
    r"\bgrazes?\s+on\b",
    r"\bfed\s+foliage\s+from\b",
    r"\binfest(?:ing|ed|ation)\b",
    r"\bobligate\s+(?:parasite|pathogen|symbiont|endoparasite)\b",
    r"\bin\s+(?:the\s+)?tissues?\s+of\b",
    r"\bnecropsy\s+revealed\b",
    r"\bdetected\s+in\s+(?:the\s+)?tissues?\s+of\b",
    r"\bspecimens?\s+harboring\b",
    r"\bharbo(?:r|uring)\w*\b",
    r"\bgall\s+bladder\s+of\b",
    r"\bisolated\s+from\s+(?:tissue|gall|cyst)\b",
    r"\bfood\s+source\s+for\b",
    r"\bdiet\s+(?:of|includes?|contains?)\b",
    r"\bgut\s+contents?\b",
    r"\bcapturing\s+and\s+consuming\b",
    r"\bpredatory\s+relationship\b",
    r"\bfeeding\s+(?:behavior|on)\b",
    r"\bcausal\s+agent\s+(?:of|for)?\b",
    r"\b(?:disease|infection)\s+caused\s+by\b",
    r"\bcausative\s+agent\b",
]
WEAK_TERMS = [
    r"\beats?\b",
    r"\bate\b",
    r"\beaten\b",
    r"\bhunts?\b",
    r"\bhunting\b",
    r"\bkills?\b",
    r"\bkilled\b",
    r"\battacks?\b",
    r"\battacked\b",
    r"\bherbivory\b",
    r"\bherbivor\w+\b",
    r"\bgrazing\b",
    r"\bcolonize[sd]?\b",
    r"\bcolonization\b",
    r"\binfests?\b",
    r"\binfestation\b",
    r"\binfested\b",
    r"\bforages?\b",
    r"\bforaging\b",
    r"\bconsumes?\b",
    r"\bconsumption\b",
    r"\bpredator\b",
    r"\bprey\b",
    r"\bparasit\w+\b",
    r"\bpathogen\b",
    r"\binfections?\b",
    r"\bvirulence\b",
    r"\bvisits?\s+flowers?\b",
    r"\bflower\s+visits?\b",
    r"\bpollination\b",
    r"\bsymbiosis\b",
    r"\bmutualism\b",
    r"\bsymbiotic\b",
    r"\bepiphyt\w+\b",
    r"\bmyrmecophil\w+\b",
    r"\binteracts?\s+with\b",
    r"\binteraction\b",
    r"\bassociated\s+with\b",
    r"\bcompetes?\s+with\b",
    r"\bcompetition\b",
    r"\bcompetitor\b",
]
LEXICON_NEGATION = [
    r"\b(?:not?|no|never|without|neither)\b",
    r"\b(?:failed\s+to|did\s+not|does\s+not|do\s+not)\b",
    r"\b(?:was\s+not|were\s+not|has\s+not|have\s+not)\b",
    r"\b(?:could\s+not|would\s+not|cannot|can't)\b",
    r"\babsence\s+of\b",
    r"\bno\s+evidence\s+(?:of|for)\b",
    r"\bnegative\s+for\b",
    r"\bnot\s+observed\b",
    r"\bnot\s+detected\b",
    r"\bfailed\s+to\s+(?:infect|parasiti|transmit|pollinate)\b",
]
LEXICON_METHOD = [
    r"\b(?:method|protocol|experiment|study\s+design)\b",
    r"\b(?:table|figure|appendix|supplementary)\b",
    r"\b(?:we\s+used|we\s+measured|we\s+analyzed|we\s+collected)\b",
    r"\b(?:statistical|significance|p\s*[<=]\s*0?\.\d+)\b",
    r"\b(?:sample\s+size|n\s*=\s*\d+)\b",
    r"\b(?:confidence\s+interval|odds\s+ratio|hazard\s+ratio)\b",
]
STRONG_WEIGHT, WEAK_WEIGHT = 0.40, 0.15
NEGATION_FACTOR, METHOD_PENALTY, METHOD_FLOOR = 0.35, 0.25, 0.05
SIGNAL_MIN = 0.15

# --- Fixed values: scientific-name detection -------------------------------------------------
BINOMIAL_CAP = r"\b([A-Z][a-z]{2,})(?:\s+(?:cf\.|aff\.|sp\.?))?\s+([a-z]{4,})\b"
BINOMIAL_LOWER = r"\b([a-z]{4,})\s+([a-z]{5,})\b"
GENUS_STOPWORDS = (
    "The This These That Those Such Each Both Other Many Some All Any Few Most More New High Low Based Using "
    "From With Into Over Under Between Among During After Before Since While Without Table Figure Study Field "
    "Sample Data However Therefore Although Because Thus Here There Where When Which For But And Our Its Two "
    "Three Four Five Six Seven Eight Nine Ten First Second Third Last Next Previous"
).split()
LOWER_STOPWORDS = (
    "the this these that those such each both other many some all any few most more new high low based using "
    "from with into over under between among during after before since while without table figure study field "
    "sample data however therefore although because thus here there where when which their have been were they "
    "than also only well upon our two three four five first second third last next results analysis method "
    "methods approach model models suggest indicate show found known used observed present described collected "
    "identified included measured conducted performed tested compared analyzed significant different similar "
    "common large small number total average level levels effect effects species genus family order class phylum "
    "kingdom infection parasite pathogen vector host prey predator"
).split()

# --- Fixed values: sentence negation, first match in this order -------------------------------
SENTENCE_NEGATION = [
    r"\b(does not|do not|did not|does n't|do n't|did n't)\s+\w+",
    r"\b(is not|are not|was not|were not|isn't|aren't|wasn't|weren't)\s+\w+",
    r"\b(cannot|can't|could not|couldn't)\s+\w+",
    r"\b(will not|won't|would not|wouldn't)\s+\w+",
    r"\bno (evidence of|sign of|indication of|record of)\b",
    r"\bfailed to (infect|parasiti|transmit|coloniz)\w*",
    r"\bnot (found|detected|observed|isolated)\b",
    r"\bunable to (infect|colonize|parasiti)\w*",
    r"\babsence of (infection|parasitism|interaction)\b",
    r"\b(refut|contradict|disprove|refute)\w*",
    r"\blacks? (the ability|capacity) to\b",
    r"\bis (not|no longer) considered (a )?(host|vector|reservoir|pathogen)\b",
]

# --- Fixed values: evidence types, weights, publication types ---------------------------------
EVIDENCE_WEIGHTS = {
    "field_observation": 1.0,
    "in_vivo_experiment": 0.75,
    "lab_experiment": 0.55,
    "genomic_inference": 0.50,
    "meta_analysis": 0.40,
    "unknown": 0.30,
}
EVIDENCE_PATTERNS = {
    "field_observation": [
        r"\bwas found (to|in|on)\b",
        r"\bwere found (to|in|on)\b",
        r"\bcollected from\b",
        r"\bobserved (in|on|to)\b",
        r"\bfield (survey|study|collection|observation)\b",
        r"\bwild(life)?\b.*\b(collected|captured|sampled)\b",
        r"\b(trapped|captured|sampled) (in|from) (the )?(field|nature|wild)\b",
        r"\bnaturally (infect|parasiti|predat)\w+\b",
    ],
    "in_vivo_experiment": [
        r"\bin vivo\b",
        r"\b(mice|rats|rabbits|hamsters|guinea pigs|monkeys)\b.{0,80}\b(infected|inoculated|challenged|administered)\b",
        r"\b(infected|inoculated|challenged|administered)\b.{0,80}\b(mice|rats|rabbits)\b",
        r"\banimal model\b",
        r"\bexperimental(ly)? infect\w*\b",
        r"\bexperimental(ly)? inoculat\w*\b",
    ],
    "lab_experiment": [
        r"\bin vitro\b",
        r"\bcell (culture|line)\b",
        r"\bunder laboratory conditions\b",
        r"\bcultur(ed|ing|e) (with|in)\b",
        r"\b(petri dish|flask|well plate|culture medium)\b",
        r"\binoculated (with|into) (a )?(culture|medium|agar)\b",
    ],
    "genomic_inference": [
        r"\bphylogenetic analysis\b",
        r"\bgenome (comparison|analysis|sequencing)\b",
        r"\b(16S|18S|ITS|COI|rbcL)\b.{0,40}\bidentif\w+\b",
        r"\bwhole[- ]genome\b",
        r"\bmolecular clock\b",
        r"\bsequence similarity\b",
        r"\bmetagenom\w+\b",
    ],
    "meta_analysis": [
        r"\breview of\b",
        r"\bmeta[- ]analysis\b",
        r"\bsystematic review\b",
        r"\bsurvey(ed|ing)? (studies|literature|reports)\b",
        r"\b(previous|earlier|prior) studi(es|ed)\b.{0,60}\breported\b",
        r"\bhas been reported (to|in)\b",
        r"\bhas long been known\b",
        r"\bwidely (known|accepted|reported)\b",
    ],
}
PUBLICATION_TYPES = [
    ("meta-analysis", "meta_analysis"),
    ("systematic review", "meta_analysis"),
    ("scoping review", "meta_analysis"),
    ("review", "meta_analysis"),
    ("randomized controlled trial", "in_vivo_experiment"),
    ("controlled clinical trial", "in_vivo_experiment"),
    ("clinical trial", "in_vivo_experiment"),
    ("observational study", "field_observation"),
    ("case reports", "field_observation"),
    ("twin study", "field_observation"),
    ("comparative study", "lab_experiment"),
    ("evaluation study", "lab_experiment"),
    ("validation study", "lab_experiment"),
    ("technical report", "lab_experiment"),
]

# --- Fixed values: trust scores ---------------------------------------------------------------
CURRENT_YEAR, HALF_LIFE_YEARS, UNKNOWN_YEAR_SCORE = 2026, 15.0, 0.4
TRUST_AXIS_WEIGHT = 0.20
CONFIRMED_SCORE, UNCONFIRMED_SCORE = 1.0, 0.35
NOTICE_RANK = {"retraction": 3, "expression of concern": 2, "correction": 1}
SCORE_RETRACTED, SCORE_CORRECTED, SCORE_CLEAN, SCORE_UNKNOWN = 0.0, 0.6, 1.0, 0.85
GRADES = [(0.85, "A"), (0.70, "B"), (0.55, "C"), (0.40, "D")]

# --- Fixed values: interaction categories and required minimum counts --------------------------
CATEGORY_MINIMUMS = {
    "PREDATION": 200,
    "PARASITISM": 200,
    "ENDOPARASITISM": 200,
    "PARASITOIDISM": 50,
    "INFECTION": 200,
    "VECTOR": 50,
    "POLLINATION": 50,
    "HERBIVORY": 50,
    "DISPERSAL": 20,
    "SYMBIOSIS": 50,
    "REGULATION": 20,
    "GENERIC": 20,
}
CATEGORY_OF_TYPE = {
    "preysOn": "PREDATION",
    "eats": "PREDATION",
    "hasHost": "PARASITISM",
    "parasiteOf": "PARASITISM",
    "endoparasiteOf": "ENDOPARASITISM",
    "pathogenOf": "INFECTION",
    "kleptoparasiteOf": "PARASITISM",
    "pollinates": "POLLINATION",
    "visitsFlowersOf": "POLLINATION",
    "symbioticWith": "SYMBIOSIS",
    "mutualistOf": "SYMBIOSIS",
    "interactsWith": "GENERIC",
    "parasitoidOf": "PARASITOIDISM",
    "vectorOf": "VECTOR",
    "transmits": "VECTOR",
    "grazesOn": "HERBIVORY",
}
CATEGORY_RULES = [
    (r"\bendoparasit|intercellular endoparasit|intracellular endoparasit", "ENDOPARASITISM"),
    (r"\bparasitoid|idiobiont|koinobiont|ectoparasitoid|lays eggs (in|on)\b", "PARASITOIDISM"),
    (r"\bkleptoparasit", "PARASITISM"),
    (
        r"\bparasit|ectoparasit|hyperparasit|hemiparasit|mesoparasit|stem parasit|root parasit"
        r"|facultative parasit|obligate parasit",
        "PARASITISM",
    ),
    (
        r"\bpathogen|infect|seropositive|is (being )?transmited|was transmited|had transmited|have transmited"
        r"|has transmited|contaminate",
        "INFECTION",
    ),
    (
        r"\bvector (of|for)|is vector for|had vector|has vector|have vector|transmit(s|ted|ting|ed)?\b",
        "VECTOR",
    ),
    (
        r"\bpollinat|pollinator|visit(s|ed|ing)? flower|flower visit|had flower visited|has flower visited"
        r"|have flower visited",
        "POLLINATION",
    ),
    (
        r"\bdispers(es?|ed|ing)? seed|seeds? dispers(ed|al)|had dispersal vector|has dispersal vector"
        r"|have dispersal vector",
        "DISPERSAL",
    ),
    (r"\bgraze|grazing|grazed|herbivory|herbivore", "HERBIVORY"),
    (
        r"\bpreys? on|prey on|preyed|hunt(s|ed|ing)?|kill(s|ed|ing)?|devour(s|ed|ing)?|predator|eat(s|ing|ed)?"
        r"|ate\b|eats?\b|feed(s|ing)? on|fed on|ingest(s|ed|ing)?|trophic",
        "PREDATION",
    ),
    (
        r"\bsymbiont|symbiosis|symbiotically|mutuali|commensali|epiphyte|amensali|phoresy|phoretic|phoresis"
        r"|inquilinism|myrmecophile|antibiosis|co-roost|roosting with",
        "SYMBIOSIS",
    ),
    (
        r"\bregulate|regulates|regulated by|regulation|represses|increase expression|decreases expression"
        r"|positively regulate|negatively regulate|directly (activate|inhibit)|indirectly (activate|inhibit)"
        r"|capable of (neg|pos)atively",
        "REGULATION",
    ),
]

# --- Fixed values: how specific an interaction term is ------------------------------------------
TERM_SPECIFICITY = {
    "parasitizes": 1.0,
    "parasitize": 1.0,
    "parasitized by": 1.0,
    "ectoparasite of": 1.0,
    "endoparasite of": 1.0,
    "hyperparasite of": 1.0,
    "parasitoid of": 1.0,
    "pathogen of": 0.95,
    "infects": 0.95,
    "vector of": 0.95,
    "preys on": 0.9,
    "predator of": 0.9,
    "hunts": 0.85,
    "kills": 0.85,
    "pollinates": 0.9,
    "pollinator of": 0.9,
    "disperses seeds of": 0.9,
    "symbiont of": 0.85,
    "mutualist of": 0.85,
    "feeds on": 0.7,
    "eats": 0.65,
    "consumes": 0.65,
    "herbivore of": 0.7,
    "grazes on": 0.7,
    "host of": 0.6,
    "colonizes": 0.6,
    "interacts with": 0.4,
    "associated with": 0.35,
    "found on": 0.3,
    "found in": 0.3,
    "occurs with": 0.3,
    "with": 0.1,
    "and": 0.05,
    "near": 0.1,
}
DEFAULT_SPECIFICITY = 0.5

# --- Fixed values: cues of wrongly accepted sentences -------------------------------------------
INTERACTION_STEMS = (
    "parasit infect prey predat eat consum feed pollinat host coloniz attack kill hunt vector transmit symbio "
    "mutual herbivor graz pathogen diseas associat interact"
).split()
WRONG_ACCEPT_CUES = [
    "phylogen", "taxonom", "classif", "nomenclat", "systemat",
    "sequenc", "genom", "dna", "rna", "gene ", "transcript",
    "morpholog", "anatomic", "fossil", "extinct",
    "distribut", "range", "habitat", "biogeograph",
    "conserv", "endanger", "iucn", "protect",
    "evolut", "diverge", "clade", "monophyl",
    "specimen", "museum", "collect", "voucher",
    "describ", "species nov", "sp. nov", "n. sp",
]

# --- Fixed values: candidate rejection patterns --------------------------------------------------
APPOSITION = [
    r"\bthe\s+([a-z][a-z\- ]{3,25}?),\s+([A-Z][a-z]+ [a-z]{3,})\b",
    r"\b([A-Z][a-z]+ [a-z]{3,}),?\s+\(?the\s+([a-z][a-z\- ]{3,25}?)\)",
]
CLADE_IN_PARENTHESES = r"\(((?:[A-Z][a-z]+\s*:\s*)+[A-Z][a-z]+)\)"
AUTHOR_AND_YEAR = (
    r"\b([A-Z][a-z]+ [a-z]{3,})\s*\(?\b([A-Z][a-z]{3,})(?:\s*&\s*[A-Z][a-z]+)?,?\s*(?:1[6-9]\d\d|20[0-2]\d)\)?"
)
AUTHOR_IN_PARENTHESES = r"\b([A-Z][a-z]+ [a-z]{3,})\s*\(\s*([A-Z][a-z]{3,})\s*\)"
AUTHOR_STOPWORDS = (
    "species genus strain isolate sample study group family order class type form variety subspecies complex "
    "clade sequence gene"
).split()
NON_BIOTIC_RELATION = (
    r"^(?:relative to|related to|closely related|close relative|relatives?|sister|hybridi[sz]ation|hybridi[sz]ed"
    r"|migration|migrat\w*|originated from|origin|compared (?:to|with)|similar to|divergen\w*|phylogen\w*"
    r"|congener\w*|distinguished from|differs? from|resembl\w*)$"
)
DENIAL_SCOPE = r"\b(?:no|not)\s+(?:\w+\s+){0,2}?(?:infections?|infested|infected)\s+with\b([^.;]{0,160})"
NOT_ORGANISM = (
    "phyllodes leaves roots stems seeds fruits flowers paralysis lesions symptoms tumor tumour syndrome lesion"
).split()
HOST_ADJECTIVES = "equine avian bovine porcine canine feline ovine caprine murine simian piscine human swine".split()
PATHOGEN_HEAD = (
    r"(?:influenza|virus|viruses|viral|schistosomes?|malaria|tuberculosis|leukemia|leukaemia|herpes\w*|corona\w*"
    r"|pox\w*|parvo\w*|rota\w*|papilloma\w*|plasmodi\w*|trypanosom\w*|babesi\w*|leishmani\w*|bacteri\w*|prions?"
    r"|retro\w*|lenti\w*|immunodeficiency)"
)

# --- Fixed values: relation direction -------------------------------------------------------------
AGENT_NOUN = (
    r"^(pathogen|parasite|parasitoid|predator|ectoparasite|endoparasite|hyperparasite|kleptoparasite|mesoparasite"
    r"|symbiont|vector|epiphyte|pollinator|consumer|grazer|herbivore|infector)s?( of| for| to)?$"
)
AGENT_VERB = (
    r"^(infect|prey|eat|invad|coloni[sz]|parasiti[sz]|pollinat|transmit|attack|kill|consum|graz|hunt|feed|visit"
    r"|ingest|contaminat|infest|affect|bait|regulat|neutrali[sz]|attract|disperse|has )"
)
PATIENT_FORM = (
    r"( by$)|^(exposed to|resistance to|resistant to|susceptible to|host|hosts|host of|host for|hosts of|hosts for"
    r"|prey of|preyed|victim|reservoir)$"
)
SYMMETRIC_FORM = (
    r"^(interacts? with|associated with|co-?occurs? with|symbiosis|mutualism|commensalism|parasite-host|coevolv"
    r"|migrates? with|adjacent|present in|found in|co-roosts? with|cooperates? with|communicates? with"
    r"|copulates? with)"
)
ACTIVE_FORM = (
    r"^(parasiti[sz]|infest|infect|coloni[sz]|invad|attack|kill|consum|graz|hunt|pollinat|predat|prey|eat|ingest"
    r"|contaminat)(ing|es|e|s)?$"
)
CLADE_PRIOR = {
    "Microsporida": 88, "Apicomplexa": 88, "Trypanosomatida": 88, "Metakinetoplastina": 88,
    "Peronosporomycetes": 86, "Oomycota": 86,
    "Phthiraptera": 78, "Siphonaptera": 78, "Hippoboscidae": 78, "Parasitoida": 78,
    "Chalcidoidea": 76, "Ixodida": 78, "Acari": 70, "Strepsiptera": 78,
    "Nematoda": 75, "Tylenchomorpha": 75, "Platyhelminthes": 75, "Acanthocephala": 75,
    "Fungi": 80, "Ascomycota": 80, "Basidiomycota": 80,
    "Bacteria": 90, "Archaea": 88, "Viruses": 100, "Tenericutes": 90,
    "Ciliophora": 60, "Amoebozoa": 60, "Euglenozoa": 60,
    "Bacillariophyta": 10, "Rhodophyta": 12, "Ulvophyceae": 12, "Phaeophyceae": 12,
    "Viridiplantae": 15, "Chloroplastida": 15, "Embryophyta": 15, "Magnoliopsida": 15,
    "Vertebrata": 20, "Craniata": 20, "Aves": 20, "Mammalia": 20, "Actinopterygii": 20,
    "Arthropoda": 50, "Insecta": 50, "Mollusca": 45, "Annelida": 45, "Metazoa": 40,
    "Eukaryota": 30,
}

# --- Fixed values: typed relations of the graph ----------------------------------------------------
ENTITY_TYPE_RELATIONS = [
    ("PATHOGEN", "HOST", "infects", True, "RO_0002556"),
    ("HOST", "PATHOGEN", "infected_by", True, "RO_0002557"),
    ("VECTOR", "HOST", "transmits_to", True, "RO_0002459"),
    ("VECTOR", "PATHOGEN", "carries", True, None),
    ("PATHOGEN", "DISEASE", "causes", True, "RO_0003304"),
    ("DISEASE", "HOST", "affects", True, None),
    ("RESERVOIR", "PATHOGEN", "reservoir_for", True, None),
    ("PATHOGEN", "RESERVOIR", "uses_reservoir", True, None),
    ("HOST", "HOST", "coInfects_with", False, None),
]
SYMMETRIC_RELATIONS = [
    "symbioticWith",
    "symbiotically interacts with",
    "mutualistOf",
    "mutualistically interacts with",
    "interactsWith",
    "biotically interacts with",
    "coHabitsWith",
    "ecologically co-occurs with",
    "amensalism",
    "amensalistically interacts with",
    "antibiosis",
    "commensually interacts with",
    "coInfects_with",
]

# --- Fixed values: sentence and passage limits ------------------------------------------------------
SENTENCE_MIN, SENTENCE_MAX, SENTENCE_MIN_WORDS, SENTENCE_MIN_LETTERS = 40, 600, 8, 30
PASSAGE_MIN, PASSAGE_MAX = 50, 800
PASSAGE_METHOD = [
    r"\bwe\s+(?:used|employed|treated|incubated|inoculated)\b",
    r"\bwere\s+(?:inoculated|treated|incubated|exposed)\s+(?:with|to)\b",
    r"\bin\s+vitro\b",
    r"\bpetri\s+dish\b",
    r"\bcell\s+culture\b",
    r"\bexperimental\s+(?:infection|setup|design)\b",
]
ABBREVIATIONS = [
    "Dr.", "Mr.", "Mrs.", "Ms.", "Prof.", "et al.", "etc.", "vs.",
    "Fig.", "Figs.", "sp.", "spp.", "cf.", "i.e.", "e.g.", "ca.",
]
FALSE_NEGATIVE_PATTERNS = [
    r"\b(?:is|are)\s+(?:a\s+)?(?:parasite|parasites)\s+of\b",
    r"\bparasitizes?\b",
    r"\bpreys?\s+on\b",
    r"\bis\s+(?:a\s+)?(?:predator|prey)\s+(?:of|for)\b",
    r"\bpollinates?\b",
    r"\binfects?\b.*\bwas\s+(?:confirmed|detected|documented)\b",
    r"\bhost\s+(?:of|for)\b",
    r"\bis\s+(?:a\s+)?vector\s+(?:of|for)\b",
    r"\bserves\s+as\s+host\s+for\b",
]
FALSE_NEGATIVE_NEGATION = [
    r"\bnot?\b",
    r"\bno\b",
    r"\bneither\b",
    r"\bwithout\b",
    r"\babsence\b",
    r"\bfailed\b",
    r"\bdid\s+not\b",
    r"\bwas\s+not\b",
    r"\bcould\s+not\b",
]
HARD_NEGATIVE_TYPES = ["none_two_species", "none_three_species"]
HARD_NEGATIVE_WORDS = ["parasite", "pathogen", "predator", "vector", "host", "infect", "prey", "pollinate"]
MAJOR_TYPES = [
    "preysOn", "parasiteOf", "infects", "eats", "pollinates",
    "hostOf", "pathogenOf", "vectorOf", "endoparasiteOf",
]
GATE_LIMITS = {
    "unknown_names": 0.01,
    "rule_violations": 0.005,
    "single_pattern": 0.70,
    "hard_negatives": 0.50,
    "positive_low": 0.20,
    "positive_high": 0.50,
    "missing_types": 3,
    "positives_without_signal": 0.20,
    "negatives_with_strong_term": 0.02,
}
TRUE_TITLE_WORDS = ["we ", "our ", "this study", "here we", "was ", "were "]
BACTERIA_SUFFIXES = ["bacteria", "bacillus", "coccus", "monas"]
PLANT_SUFFIXES = ["aceae", "ales", "phyta", "phyte", "opsida"]
FUNGI_SUFFIXES = ["mycota", "mycetes", "mycetidae"]
ANIMAL_SUFFIXES = ["idae", "inae", "oidea", "iformes", "morpha"]

# --- Fixed values: keyword tiers of the quality scores ------------------------------------------------
KEYWORDS_L1 = [
    "infect", "infection", "infected", "infecting", "infectious",
    "parasite", "parasites", "parasitic", "parasitize", "parasitized", "parasitism",
    "pathogen", "pathogens", "pathogenic", "pathogenicity",
    "vector", "vectors", "vectored",
]
KEYWORDS_L2 = [
    "host", "hosts", "hosted", "hosting",
    "prey", "preys", "preyed", "predator", "predators", "predation", "predatory",
    "symbiont", "symbionts", "symbiosis", "symbiotic",
    "mutualist", "mutualism", "mutualistic",
    "colonize", "colonized", "colonization", "colonizing",
    "infestation", "infest", "infested", "infesting",
    "transmitted", "transmit", "transmission",
]
KEYWORDS_L3 = [
    "feeds on", "fed on", "feeding on", "feed on",
    "eats", "eating", "consumed", "consuming",
    "attacked", "attacking", "attacks",
    "killed", "killing", "kills",
    "disease", "diseases", "diseased",
    "virulent", "virulence",
]
INTERACTION_PHRASES = [
    "is a parasite of", "parasitizes", "is parasitized by",
    "is a host of", "is hosted by", "serves as host",
    "is a vector of", "is vectored by", "transmits",
    "preys on", "is prey of", "is preyed upon",
    "infects", "is infected by", "causes infection",
    "feeds on", "is fed upon",
    "attacks", "is attacked by",
    "colonizes", "is colonized by",
]
NON_INTERACTION = [
    "phylogenet", "taxonom", "systemat", "classif", "clade",
    "sequenc", "genom", "pcr", "amplif", "primer", "dna", "rna", "gene",
    "morpholog", "anatomic", "structur",
    "distribut", "geograph", "habitat", "ecosystem", "biome",
    "conserv", "endanger", "extinct", "iucn",
    "fossil", "evolution", "diverge", "speciat",
    "cultivation", "laboratory", "in vitro", "cell line",
]

# --- Fixed values: patterns for and against a real interaction, on lower-cased text ---------------------
INFECTION_PATTERNS = [
    r"\binfect(?:s|ed|ing|ion|ious)?\b.*\b(?:with|by|of|in|from)\b",
    r"\b(?:with|by)\b.*\binfect",
    r"\bcaus(?:e[sd]?|ing)\s+(?:\w+\s+)?(?:disease|infection|illness|syndrome)",
    r"\b(?:disease|infection|illness)\s+(?:caused|due)\s+(?:by|to)\b",
    r"\bpathogen(?:s|ic)?\s+(?:of|in|for)\b",
    r"\b(?:agent|organism)\s+(?:of|causing)\s+\w+\s+(?:disease|infection)",
]
HOST_PARASITE_PATTERNS = [
    r"\bhost(?:s|ed)?\s+(?:of|for|to)\b",
    r"\b(?:intermediate|definitive|final|paratenic|reservoir)\s+host",
    r"\bparasit(?:e[sd]?|ic|ism|iz)",
    r"\bvector(?:s|ed)?\s+(?:of|for|by)\b",
    r"\btransmit(?:s|ted|ting)?\s+(?:by|to|from)\b",
    r"\b(?:transmitted|spread|carried)\s+by\b",
    r"\bcarrier(?:s)?\s+(?:of|for)\b",
]
PREDATION_PATTERNS = [
    r"\bprey(?:s|ed)?\s+(?:on|upon)\b",
    r"\bpredator(?:s|y)?\s+(?:of|on)\b",
    r"\bpredation\s+(?:on|of|by)\b",
    r"\bfeed(?:s|ing)?\s+(?:on|upon)\b",
    r"\bfed\s+(?:on|upon|to)\b",
    r"\bgraze[sd]?\s+(?:on|upon)\b",
    r"\bgrazing\s+(?:on|by)\b",
]
OTHER_INTERACTION_PATTERNS = [
    r"\bcoloniz(?:e[sd]?|ation|ing)\b",
    r"\binvad(?:e[sd]?|ing)\b",
    r"\binvasion\s+(?:of|by|in)\b",
    r"\binfest(?:s|ed|ing|ation)?\b",
    r"\bsymbio(?:nt|sis|tic)\b",
    r"\bmutual(?:ist|ism|istic)\b",
    r"\bcommensal(?:ism)?\b",
    r"\bendosymbio",
    r"\bpollinat(?:e[sd]?|ing|ion|or)\b",
    r"\bflower(?:s)?\s+visited\s+by\b",
    r"\bvisit(?:s|ed|ing)?\s+flower",
    r"\b(?:mice|rats?|rabbits?|hamsters?|monkeys?|dogs?|guinea\s*pigs?)\s+"
    r"(?:infected|inoculated|challenged|exposed)\s+(?:with|to)\b",
    r"\b(?:inoculated?|challenged?)\s+(?:with|into)\s+\w+",
    r"\bexperimental\s+(?:infection|challenge)\b",
    r"\b(?:given|administered|injected)\s+\w+\s+(?:into|to)\s+(?:mice|rats?|rabbits?)",
    r"\b(?:larvae?|cercariae?|metacercariae?|miracidia|oocysts?|sporozoites?|cysts?)\s+(?:in|of|from)\s+\w+",
    r"\b(?:develop(?:s|ed|ing)?|matures?|stages?)\s+in\s+\w+\s+(?:host|tissue|organ)",
    r"\blife\s*cycle\s+(?:in|of)\b",
    r"\b(?:antibod(?:y|ies)|antigen)\s+(?:to|against|from)\s+\w+",
    r"\bimmun(?:e|ity|ization)\s+(?:to|against|response)\b",
    r"\bresist(?:ant|ance)\s+to\s+\w+\s+(?:infection|disease|organism)",
    r"\bvaccinat(?:e[sd]?|ion)\s+(?:against|with)\b",
]
NO_INTERACTION_PATTERNS = [
    r"\b(?:purified|isolated|extracted|obtained|derived|prepared)\s+from\s+\w+\s+"
    r"(?:tissue|serum|blood|plasma|liver|kidney|brain|muscle|cell|organ)",
    r"\b(?:from|of)\s+\w+\s+(?:liver|kidney|brain|muscle|tissue|serum|plasma|blood|cells?)\b",
    r"\b(?:enzyme|protein|antibody|antigen|dna|rna|gene)\s+(?:from|of)\s+\w+\b",
    r"\bsimilar\s+to\s+(?:that|those)\s+(?:of|from|in)\b",
    r"\bdifferent\s+from\s+(?:that|those)\s+(?:of|from|in)\b",
    r"\bsame\s+as\s+(?:that|those|in)\b",
    r"\banalogous\s+to\b",
    r"\bhomologous\s+(?:to|with)\b",
    r"\bidentical\s+to\s+(?:that|those)\b",
    r"\bresembles?\s+(?:that|those)\b",
    r"\bcompared?\s+(?:to|with)\s+(?:that|those)\b",
    r"\bamino\s+acid\s+(?:sequence|composition|content)\b",
    r"\bnucleotide\s+sequence\b",
    r"\bprotein\s+(?:sequence|structure)\b",
    r"\bmolecular\s+weight\b",
    r"\bisoelectric\s+point\b",
    r"\belectrophoretic\s+(?:mobility|pattern)\b",
    r"\bchromatograph(?:y|ic)\b",
    r"\bsequence\s+(?:of|was|were|analysis|determination|homology)\b",
    r"\bcloned?\s+(?:in|into)\s+(?:e\.?\s*coli|escherichia)\b",
    r"\bexpressed?\s+(?:in|by)\s+(?:e\.?\s*coli|escherichia)\b",
    r"\btransformed?\s+(?:into|with)\s+(?:e\.?\s*coli|escherichia)\b",
    r"\b(?:plasmid|vector)\s+(?:in|into)\s+(?:e\.?\s*coli|escherichia)\b",
    r"\bbelongs?\s+to\s+(?:the\s+)?(?:genus|family|order|class)\b",
    r"\bclassified\s+(?:as|in|with)\b",
    r"\bphylogenetic(?:ally)?\s+(?:related|relationship|position)\b",
    r"\btaxonom(?:y|ic|ically)\b",
]
DISEASE_CONTEXT = r"\b(?:disease|infection|illness|syndrome)\s+(?:in|of|caused|due)\b"
TREATED_ANIMALS = (
    r"\b(?:mice|rats?|rabbits?|hamsters?)\s+(?:were|was|are|is)\s+(?:used|given|treated|injected|challenged)"
)
ORGANISM_IN_ORGANISM = r"\bin\s+(?:infected|diseased|healthy)\s+(?:mice|rats?|humans?|patients?|animals?)"
CAUSATION = r"\b(?:due\s+to|caused\s+by)\s+\w+"
BIOLOGY_WORDS = ["phagocytos", "endocytos", "virulence", "pathogenic", "toxin", "lethal", "mortality"]
MOLECULE_WORDS = [
    "sequence", "amino acid", "nucleotide", "molecular", "purification", "isolation", "chromatography",
]
COMPARISON = r"\b(?:similar|different|same|compared|identical|analogous)\b"
COMPARISON_EXCEPTION = r"\binfect|\bhost|\bparasite|\bvector|\bprey|\bfeed"
CONTEXT_HINTS = [
    "in mice", "in rats", "in rabbit", "in human", "in patient",
    "to mice", "to rats", "from mice", "from rats",
    "against", "response to", "effect on", "effect of",
]

# --- Fixed values: name-qualifier and authorship patterns --------------------------------------------------
TRAILING_PARENTHESIS = r"\s*\([^()]*\)\s*$"
TRAILING_YEAR = r"\s*,?\s*\d{4}\s*$"
TRAILING_AUTHOR = r"\s+[A-Z][A-Za-z'’.\-]*\.?$"
TRAILING_PARTICLE = r"(?i)\s+(?:van|von|de[nrl]?|del|della|di|da|la|le|el|du|dos|das|bin|ibn|ter|ten)$"
RANK_TAGS = r"(?i)\b(?:subsp|ssp|var|cf|aff|sp|spp|nr|gen|f)\.?\b"
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
FUZZY_MIN_SIMILARITY, FUZZY_MIN_LENGTH = 0.90, 8
KINGDOM_RANKS = ["kingdom", "domain", "superkingdom"]

# --- Fixed values: co-listed taxa -----------------------------------------------------------------------------
LIST_SPAN_MAX = 80
LIST_GAP = r"[\sA-Za-z0-9.,;&'()\-‐-―]"
LIST_BREAKERS = (
    "of in on by with from to as that which for is are was were be been being has have had "
    "infect infects infected infecting parasit parasite preys prey predator transmit transmits host hosts "
    "causes cause caused associated feeding feeds pollinat symbio vector isolated found during after before "
    "between within than such including like against via through"
).split()

# --- Fixed values: document trust ---------------------------------------------------------------------------------
DOCUMENT_WEIGHTS = {
    "self_retraction": 0.35,
    "self_temporal": 0.15,
    "foundation_retraction": 0.30,
    "foundation_temporal": 0.20,
}
RETRACTED_CAP, RETRACTED_SLOPE, NEUTRAL_FOUNDATION, OLD_BASE_AGE, RECENT_AGE = 0.15, 6.0, 0.5, 25, 10
