"""Fixed values.

These strings and numbers must equal the ones the original chat tooling used,
otherwise rendered records, prompts and routing decisions differ. They are kept
together here, verbatim and in their natural order.
"""

# ---- fixed values: record markers and placeholders -------------------------
BEGIN_MSG = "[MSG]"
END_MSG = "[MEG]"
SEP = "[FS]"
PLACEHOLDER_TEXT = "(image or file)"
DEFAULT_SENDER = "Anonym"
TIME_FORMAT = "HH:mm"  # Python "%H:%M"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"

# ---- fixed values: handle folding ------------------------------------------
HANDLE_MAX_LEN = 60
HANDLE_FOLD_FROM = "äöåÄÖÅ"
HANDLE_FOLD_TO = "aoaAOA"

# ---- fixed values: sequence and segment parameters (defaults) --------------
SEQ_LEN_V1 = 25
SEQ_LEN_V2 = 15
SEQ_MIN_LEN = 10
SEQ_MAX_ID_GAP = 4
SEQ_MAX_MINUTES = 60
VALIDATION_FRAC = 0.2
SEGMENT_LEN = 10
SEGMENT_MAX_CHARS = 200
SEGMENT_MAX_TOKENS = 350
SEGMENT_TEST_FRAC = 0.1
SEGMENT_BOT_NAME = "FinGPT_bot"
SEGMENT_ID_BASE_MIN = -1000
SEGMENT_ID_BASE_MAX = 1000
CONTEXT_INIT_ROWS = 20
TOKEN_BUDGET_DEFAULT = 2048
TOKEN_BUDGET_APP = 4000
CHARS_PER_TOKEN = 3
HEAD_SAMPLE_ROWS = 100

# ---- fixed values: bot names -------------------------------------------------
BOT_NAME_API = "Teekkariäly"
BOT_NAME_LOCAL = "FinGPT_bot"
BOT_ALIASES = ("FinGPTbot",)

# ---- fixed values: system texts of the chat training files -------------------
SYSTEM_TEXT_V1 = ("Olet osana Laskennallisen tekniikan (teekkarien) keskustelua. Koita sopeutua "
                  "mahdollisimman hyvin joukkoon, äläkä kerro olevasi tekoäly.")
SYSTEM_TEXT_V2 = " ".join((
    "You are part of a Telegram group chat between Computational Engineering students from Finland.",
    "Keskustelu on suomeksi, ja opiskelijat ovat Teekkareita Lappeenrannan teknillisestä yliopistosta.",
    "Keskustelu on kavereiden keskistä, ja aiheet vaihtelevat laidasta laitaan.",
    "Koita sulautua joukkoon, äläkä paljasta että olet Tekoäly.",
    "Käytä Teekkarihuumoria jos se sopii tilanteeseen.",
    "Jos tahdot vastata johonkin aiempaan viestiin, lisää '@<id> ' ennen tekstiä.",
))
# The chat-prompt head uses the same text as its system preamble.
CHAT_PRE_PROMPT = SYSTEM_TEXT_V2


def local_pre_prompt(bot_name: str = BOT_NAME_LOCAL) -> str:
    """Preamble of the delimited prompt (one line, newline-terminated)."""
    return (f"Nimeni on {bot_name} ja olen hauska ja ystävällinen Teekkari tekoäly LUT:sta. "
            "Harrastan komiikkaa ja koodausta.\n")


# ---- fixed values: routing --------------------------------------------------
TRIGGERS_LOCAL = ("bot", "gpt", "?", "neuroverk", "tekoäly")
TRIGGERS_API = ("gpt", "bot", "vitsi", "teekkariäly")
PROB_LOCAL = 0.1
PROB_API = 0.12
CMD_HELP = "/gpt-help"
CMD_JOKE = "/vitsi"
CONTENT_TYPES = ("text", "sticker", "photo", "audio", "video", "document")

INTRO_TEXT = ("Kiitos ryhmään pääsystä! Olen Teekkariuteen pohjautuva tekoäly. "
              "Yritän jatkaa keskustelua samalla tyylillä, lisäten siihen huumoria, hehe.")

HELP_TEXT_LOCAL = """
        Moi!
        Olen TurkuNLP:n kouluttamaan suomalaiseen GPT malliin pohjautuva tekoäly, johon on lisätty huumoria LUT:sta.
        Olen koulutettu keskustelun historialla, ja yritän jatkaa keskustelua samalla tyylillä, mutta lisäten siihen huumoria.
        
        Komennot:
        /gpt-help - Tietoa komennoista
        /vitsi [mistä] - Lähetä vitsi. 'mistä' voi specifioida mistä aiheesta vitsi halutaan. Esim. '/vitsi Teemu'
        """

HELP_TEXT_API = ("Moi! Olen GPT-4o-mini malliin perustuva tekoäly: "
                 "Teekkariäly. Minut on koulutettu Lateksii keskusteluilla, ja yritän jatkaa keskustelua "
                 "luontevasti. Minä luen aina viestit, jos minulle saapuu viesti jossa on jotain seuraavista: "
                 "['gpt', 'bot', 'vitsi', 'teekkariäly']."
                 "Vastaan myös aina jos vastaat viestiini (reply)."
                 " Toimin myös Komennoilla:\n"
                 "\t- /gpt-help - Tietoa komennoista"
                 "\t- /vitsi [mistä] - Lähetä vitsi. 'mistä' voi specifioida mistä "
                 "aiheesta vitsi halutaan. Esim. '/vitsi Teemu'."
                 "\nMeillä tulee varmana olemaan hauskaa!")

JOKE_OPENERS = (
    "Keksin eile hauskan vitsin",
    "Tässä teille hauska Teekkari vitsi",
    "Ai että, tuli hauska vitsi mieleen",
    "Siis kuulin tän vitsin eilen",
    "Kotiseutukursioilla kuulin tän vitsin",
)
JOKE_BEGINS = (
    "Mikä on",
    "Mitä saa kun",
    "Kuinka monta",
    "Miksi",
    "Olipa kerran",
    "",
)
JOKE_RANDOM_PROMPT = ("Kerro random vitsi, joka mieluusti liittyy chatin historiaan, teekkariuteen, "
                      "tai on muuten vaan hauska.")
JOKE_TOPIC_PROMPT = "Kerro vitsi aiheesta "
RESPONSE_PASS = "pass"
