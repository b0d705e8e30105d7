"""What a ticker or a display name says: its venue and its asset class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ends of tickers and the venue of their home market.
SUFFIXES = {
    ".NS": "XBOM", ".BO": "XBOM", ".L": "XLON", ".TO": "XTSE", ".AX": "XASX", ".SS": "XSHG", ".SZ": "XSHG", ".HK": "XHKG", ".T": "XTKS", ".KS": "XKRX", ".KQ": "XKRX",
    ".TW": "XTAI", ".SI": "XSES", ".DE": "XETR", ".F": "XFRA", ".PA": "XPAR", ".AS": "XAMS", ".BR": "XBRU", ".MC": "XMAD", ".MI": "XMIL", ".SW": "XSWX",
}
# Ends of pairs that trade every day.
CRYPTO = ("-USD", "-USDT", "-USDC", "-EUR", "-GBP", "-JPY", "-BTC", "-ETH")
# Indices by name, and the beginnings of Indian ones.
INDICES = {
    "^GSPC": "XNYS", "^DJI": "XNYS", "^NDX": "XNYS", "^IXIC": "XNYS", "^RUT": "XNYS", "^VIX": "XNYS", "^OEX": "XNYS", "^GDAXI": "XETR", "^FCHI": "XPAR", "^STOXX50E": "XPAR", "^FTSE": "XLON", "^IBEX": "XMAD",
    "^AEX": "XAMS", "^SSMI": "XSWX", "^N225": "XTKS", "^TPX": "XTKS", "^KS11": "XKRX", "^KQ11": "XKRX", "^HSI": "XHKG", "^TWII": "XTAI", "^STI": "XSES", "^AXJO": "XASX",
}
INDIAN = ("^NSE", "^CNX", "^NSM", "^CRSLDX", "^BSE")
# Tickers whose class their name does not tell.
TICKERS = {
    "Rates": "BIL SHV SGOV SHY VGSH IEI IEF VGIT TLH TLT VGLT GOVT BSV BLV AGG BND BNDW BNDX IGOV BWX IEGA.L IBGL.L SDEU.L IGLT.L VGB.AX XBB.TO IIND.L LTGILTBEES.NS GILT5YBEES.NS LIQUIDBEES.NS CBON CNYB.L ^IRX ^FVX ^TNX ^TYX",
    "Credit": "LQD VCSH VCIT VCLT HYG JNK GHYG BGRN PFF CWB FALN MBB VMBS BKLN MUB VTEB FLOT IEAC.L SLXX.L IBND EMB PCY EMLC EMHY EBBETF0430.NS",
    "Inflation": "TIP VTIP SCHP WIP INXG.L RINF",
    "Commodity Broad": "DBC GSG",
    "Metals": "DBB GLTR PALL LIT URA SLX REMX XME PICK XLB GC=F SI=F HG=F PL=F PA=F",
    "Energy": "XLE CL=F BZ=F NG=F RB=F HO=F",
    "Agriculture": "DBA ZC=F ZW=F ZS=F ZL=F CT=F KC=F SB=F CC=F JEERA.NCDEX",
    "Volatility": "^VIX VIXM ^MOVE",
    "Real Assets": "VNQ VNQI REET XLRE WOOD IGF",
    "Currency": "DX-Y.NYB UUP UDN USDU FXE FXY FXB FXF FXA FXC CEW",
}
# Patterns of display names, whatever their case; the first that is found holds.
PATTERNS = (
    (r"volatilit|\bvix\b|\bmove\b", "Volatility"),
    (r"reit|real estate|infrastructure|timber|forestry", "Real Assets"),
    (r"inflation|tips|linker|breakeven", "Inflation"),
    (r"treasury|gilt|bund|schatz|g-sec|sovereign|govt bond|government bond|aggregate bond|total bond|yield$|overnight rate|broad bond", "Rates"),
    (r"corporate|high yield|municipal|mortgage|senior loan|preferred|convertible|fallen angel|credit|green bond|floating rate|psu bond", "Credit"),
    (r"gold|silver|copper|platinum|palladium|base metals|precious|lithium|uranium|steel|rare earth|metals & mining|miners", "Metals"),
    (r"crude|brent|natural gas|gasoline|heating oil|\bwti\b", "Energy"),
    (r"corn|wheat|soybean|cotton|coffee|sugar|cocoa|jeera|cumin|agricultur|grain", "Agriculture"),
    (r"broad commodity|commodity index", "Commodity Broad"),
    (r"dollar|\bfx\b|currency|currencies|/[A-Z]{3}\b|\b[A-Z]{3}/", "Currency"),
    (r"equity|equities|nasdaq|s&p|russell|nikkei|kospi|kosdaq|dax|cac|stoxx|ftse|ibex|\baex\b|\bsmi\b|composite|component|shenzhen|shanghai|china broad|sector|semiconductor|homebuilder|transport|value|growth|momentum|low volatility|high beta|high dividend|banks|large cap|small cap|mid cap|acwi|index$", "Equity"),
)
# Beginnings of tickers that are equity if nothing else is known.
EQUITY = ("^", "XL", "EW", "IW", "V", "MTUM", "USMV", "SPHB")


def _first(rules: list[tuple[Column, str]], other: Column) -> Column:
    """The value of the first rule that holds."""
    out = other
    for test, value in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def venue(ticker: Column) -> Column:
    """The venue whose sessions a ticker keeps: an exchange, FX (weekdays), CRYPTO (every day), or '' where none is known."""
    t = F.upper(F.trim(ticker))
    ends = lambda pairs: [(t.endswith(end), place) for end, place in pairs]
    rules = ends([("=X", "FX"), ("=F", "CMES"), *[(c, "CRYPTO") for c in CRYPTO], (".SHEET", "XBOM"), (".NCDEX", "XBOM"), *SUFFIXES.items()])
    rules += [(t == name, place) for name, place in INDICES.items()] + [(t.startswith(head), "XBOM") for head in INDIAN]
    plain = t.rlike(r"^(?=.*[\p{L}\p{N}])[\p{L}\p{N}.\-]+$")
    return _first([*rules, (plain, "XNYS")], F.lit(""))


def asset_block(name: Column, ticker: Column | None = None) -> Column:
    """The asset class of a display name: by its ticker (or the name itself, if it is one), by pattern, by the ticker's shape."""
    ticker = name if ticker is None else F.coalesce(ticker, name)
    by_ticker = [(key.isin(*listed.split()), label) for key in ((ticker,) if ticker is name else (ticker, name)) for label, listed in TICKERS.items()]
    by_name = [(name.rlike(f"(?i){pattern}"), label) for pattern, label in PATTERNS]
    by_shape = [(ticker.endswith("=X"), "Currency"), (ticker.endswith("=F"), "Commodity Broad"), *[(ticker.startswith(head), "Equity") for head in EQUITY]]
    return _first([*by_ticker, *by_name, *by_shape], F.lit("Other"))
