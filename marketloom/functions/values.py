"""Word lists and patterns that decide results, each in its published order."""

#: Words that speak for rising prices.
BULLISH = ("surge", "surges", "surging", "soar", "soars", "soaring", "rally", "rallies", "bull", "bullish", "pump", "pumps", "moon", "mooning", "breakout", "breaks out", "all-time high", "ath", "record high", "new high", "buy", "buying", "accumulate", "adoption", "partnership", "approval", "approved", "etf approved", "institutional", "upgrade", "outperform", "beat", "beats", "exceeds", "growth", "profit", "green", "uptrend", "recovery", "rebound", "bounce", "support holds", "halving", "scarcity", "deflationary")

#: Words that speak for falling prices.
BEARISH = ("crash", "crashes", "crashing", "plunge", "plunges", "plunging", "dump", "dumps", "bear", "bearish", "sell-off", "selloff", "liquidation", "liquidated", "rugpull", "hack", "hacked", "hacking", "exploit", "exploited", "vulnerability", "ban", "banned", "banning", "regulation", "regulatory", "lawsuit", "sued", "fraud", "scam", "ponzi", "collapse", "collapses", "decline", "declines", "fear", "panic", "red", "downtrend", "correction", "bubble", "overvalued", "bankruptcy", "insolvency", "default", "debt", "recession", "inflation")

#: The same for Persian texts.
PERSIAN_BULLISH = ("افزایش", "رشد", "صعود", "جهش", "پامپ", "خرید", "حمایت", "مقاومت شکست", "بیشترین قیمت", "رکورد", "تأیید", "مشارکت", "همکاری", "institutional", "کسب سود", "بازگشت", "ترند صعودی", "سبز", "خوشبینانه", "چشمگیر", "چشمگیری", "رشد چشمگیر", "صعودی", "پیشرفت")
PERSIAN_BEARISH = ("سقوط", "کاهش", "نزول", "ریزش", "فروش", "panic", "ترس", "هک", "کلاهبرداری", "banned", "ممنوعیت", "شکایت", "قانون", "ورشکستگی", "بحران", "تورم", "رکود", "حباب", "بیشارزش", "قرمز", "بدبینانه", "لیکوئید", "تراژدی", "فاجعه", "نزولی", "ضرر", "ریسک")

#: Emoji and their mood.
EMOJI = {"🚀": 0.8, "📈": 0.6, "🟢": 0.5, "💪": 0.4, "🔥": 0.3, "🐂": 0.6, "💰": 0.3, "✅": 0.4, "🎯": 0.3, "⬆️": 0.3, "📉": -0.6, "🔴": -0.5, "💀": -0.7, "⚠️": -0.3, "🐻": -0.6, "🏴": -0.4, "⛔": -0.5, "🚫": -0.4, "⬇️": -0.3, "😱": -0.5, "🆘": -0.6}

#: Words of news that move markets.
IMPACT = ("fed", "fomc", "powell", "rate cut", "rate hike", "interest rate", "cpi", "pce", "inflation", "gdp", "recession", "opec", "crude", "etf", "sec", "earnings", "revenue", "guidance", "target", "all-time high", "breakout", "plunge", "rally", "liquidation", "yield", "treasury", "central bank", "tariffs", "sanctions", "ai", "breakthrough", "record", "فدرال رزرو", "نرخ بهره", "تورم", "کاهش نرخ", "افزایش نرخ", "رکود", "صندوق etf", "سقف تاریخی", "شکست مقاومت", "ریزش", "رالی", "اوراق قرضه", "بانک مرکزی", "تعرفه", "سود سهام", "درآمد سهام", "گزارش مالی", "رکورد", "جهش", "سقوط", "اوپک", "پاول")

#: Topics in the order in which they are tried.
TOPICS = {
    "security": r"\bhack(?:ed|ers?|ing)?\b|\bexploit\w*\b|\bbreach\w*\b|\bstolen\b|\bsteal(?:ing|s)?\b|\bscam\w*\b|\bphishing\b|\bransom\w*\b|\bvulnerab\w*\b|\bmal(?:w|f)are\b|\bdrain(?:ed|ing)?\b|\bseiz\w*\b|\blaunder\w*\b",
    "regulation": r"\bregulat\w*\b|\bSEC\b|\bCFTC\b|\bMiCA\b|\blegislat\w*\b|\bbill\b|\bsenate\b|\bcongress\w*\b|\blaw(?:s|maker)?\b|\bban(?:s|ned|ning)?\b|\blegal\w*\b|\bcompliance\b|\benforcement\b|\bcourt\b|\bDOJ\b|\bprosecut\w*\b|\bOCC\b|\btax\w*\b|\bclarity act\b|\bpolicy\b",
    "institutional": r"\bblackrock\b|\bgrayscale\b|\bfidelity\b|\bark invest\b|\bmicrostrategy\b|\bstrategy\b|\bcorporate\b|\binstitution\w*\b|\bbank\w*|\bstrive\b|\bbitmine\b|\bwall street\b|\bjpmorgan\b|\bgoldman\b|\bmorgan stanley\b|\bstandard chartered\b|\bbank of america\b|\bsovereign\b|\bpension\b",
    "etf": r"\betf\w*\b|\binflow\w*\b|\boutflow\w*\b|\bfund flow\w*\b|\bspot (?:bitcoin|ether|eth|btc|solana|xrp|gold|silver) etf\b|\bibit\b|\bethe\b|\bgld\b|\bslv\b",
    "macro": r"\bfed\b|\bfomc\b|\bfederal reserve\b|\binterest rate\w*\b|\brate (?:cut|hike)\w*\b|\binflation\b|\bcpi\b|\bpce\b|\bppi\b|\bgdp\b|\bunemploy\w*\b|\brecession\b|\byield\w*\b|\btreasury (?:yield|bond|note)s?\b|\bdollar (?:index|strength)\b|\bdxy\b|\bliquidity\b|\bmacro\b|\bopec\b|\boil price\w*\b|\btrade war\b|\btariff\w*\b|\bcentral bank\w*\b|\bpowell\b|\bwarsh\b",
    "analysis": r"\bforecast\b|\bpredict\w*\b|\bprice (?:target|analysis|prediction)\w*\b|\btechnical\w*\b|\bsupport\b|\bresistance\b|\brsi\b|\bmacd\b|\bchart\w*\b|\bbullish\b|\bbearish\b|\brally\b|\bcorrection\b|\bconsolidat\w*\b|\bbreakout\b|\bbreakdown\b|\bgolden cross\b|\bdeath cross\b|\bfibonacci\b|\bdivergence\b",
    "defi": r"\bdefi\b|\bliquidity pool\w*\b|\bstaking\b|\blending\b|\bvault\w*\b|\bamm\b|\bairdrop\w*\b|\bgovernance\b|\bdao\b|\brestaking\b|\btokeniz\w*\b",
    "market": r"\bwhale\w*\b|\bliquidation\w*\b|\bfunding rate\w*\b|\bopen interest\b|\bderivatives?\b|\bfutures?\b|\boptions?\b|\btrading volume\b|\bmarket cap\b|\bdump\w*\b|\bpump\w*\b|\bsurge\w*\b|\bplunge\w*\b|\bcrash\w*\b|\bspike\w*\b|\bslide\w*\b|\bsell-?off\b|\bprice\b",
    "tech": r"\bupgrade\w*\b|\bmainnet\b|\btestnet\b|\bfork\b|\beip-?\d+\b|\bbip-?\d+\b|\bprotocol\b|\bblockchain (?:update|release)\b|\bintegrat\w*\b|\bpartnership\b|\bsdk\b|\bapi\b",
}

#: Tracked assets in the order in which they are reported.
ASSETS = {
    "BTC": r"\b(?:bitcoin|btc|sats?|satoshis?)\b",
    "ETH": r"\b(?:ethereum|ether|eth|vitalik)\b",
    "SOL": r"\b(?:solana|sol)\b",
    "XRP": r"\b(?:xrp|ripple)\b",
    "ADA": r"\b(?:cardano|ada)\b",
    "BNB": r"\b(?:bnb|binance coin|binance smart chain|bsc)\b",
    "DOGE": r"\b(?:dogecoin|doge)\b",
    "XAU": r"\b(?:gold|xau(?:usd)?|bullion|ounce of gold)\b",
    "XAG": r"\b(?:silver|xag(?:usd)?|white metal)\b",
    "WTI": r"\b(?:oil|wti|crude|brent|opec|petroleum|barrel)\b",
    "DXY": r"\b(?:dxy|dollar index|usd index|greenback|us dollar)\b",
    "SPX": r"\b(?:s&p|spx|s&p 500|stock market|equities|wall street)\b",
    "VIX": r"\b(?:vix|volatility index|implied volatility)\b",
}

#: Markers of rejected and of penalised articles.
SPONSORED = r"\bsponsored\b|\badvertorial\b|\bpress release\b|\bpr manager\b|\bblockmanpr\b|\bpartner content\b|\bbrought to you by\b|\bin partnership with\b|\bweb3wire\b|\bpaid (?:post|content)\b|\bmedia release\b|\bmorningstar branded\b"
SPAM = r"\b(?:bet|casino|casinos|slots?|porn|xxx)\b"
SEO = r"\blive (?:gold|silver|bitcoin|crypto|price) price\b|\bprice (?:today|now)\b|\bhow to buy\b|\bprice prediction \d{4}\b|\bbest (?:crypto|coins?) to buy\b|\b\d+ best \w+ to buy\b|\bconverter\b|\bcalculator\b|\bmonth day, year\b|\bprice in (?:usd|inr|cad|aud|eur|gbp|pk|php)\b|\bprice of \w+ as of\b|\bcurrent price of\b|\bprice forecast \d{4}\b|\bprice target \d{4}\b"
CLICKBAIT = r"\b(?:1000x|100x|10x)\b|\bmoon\b|\bto the moon\b|\bguaranteed\b|\bshocking\b|\byou won'?t believe\b|\bthis changes everything\b|\blast chance\b|\bexplosive growth\b|\bhuge gain\w*\b|\binsane\b|\bcrazy\b|\bnobody is talking about\b|\bheres why\b|\bsecret\b|\bget rich\b|\bnext bitcoin\b|\bnext big thing\b|\bmust (?:buy|hold) now\b|\bprice explod\w*\b|\bwill 100\b"
RISKY = r"\bguaranteed (?:return|profit)s?\b|\brisk-?free\b|\b100% (?:sure|certain|guaranteed)\b|\bcan'?t (?:lose|fail)\b|\bprice (?:will )?(?:definitely|certainly) (?:go|reach)\b"

#: The relevance gate's patterns.
RELEVANT = r"\bbitcoin\b|\bbtc\b|\bcrypto\w*\b|\bethereum\b|\bether\b|\bblockchain\b|\bstablecoin\w*\b|\btoken\w*\b|\bdefi\b|\betf\b|\baltcoin\w*\b|\bsatoshi\b|\bdigital asset\w*\b|\bweb3\b|\bmeme coin\w*\b|\bhalving\b|\bmining\b|\bhashrate\b|\b(?:crypto\w*|digital) exchange\w*\b|\bstock exchange\w*\b|\bexchange rate\w*\b|\bbinance\b|\bcoinbase\b|\bkraken\b|\bokx\b|\bsec\b|\bcftc\b|\bregulat\w*\b|\bfederal reserve\b|\bfed\b|\bfomc\b|\binflation\b|\bcpi\b|\bpce\b|\binterest rate\w*\b|\brate (?:cut|hike)\w*\b|\btreasury yield\w*\b|\bdollar index\b|\bdxy\b|\bliquidity\b|\bpowell\b|\bgold\b|\bsilver\b|\bbullion\b|\bprecious metal\w*\b|\bcomex\b|\bripple\b|\bxrp\b|\bsolana\b|\bcardano\b|\bdogecoin\b|\btether\b|\busdt\b|\bcoin\b|\baltcoins?\b|\bwallet\w*\b|\bnft\w*\b|\bdex\b|\bcex\b|\bstaking\b|\bairdrop\w*\b|\btokeniz\w*\b|\brwa\b|\bdapp\w*\b|\bmainnet\b|\bbull run\b|\bbear market\b|\bcrypto market\b|\bdigital currency\b|\bmonetary policy\b|\btariff\w*\b|\bcentral bank\w*\b|\bforex\b|\bcurrencies\b|\bcurrency\b|\bfx\b|\beur/?usd\b|\bgbp/?usd\b|\busd/?jpy\b|\baud/?usd\b|\busd/?cad\b|\byen\b|\beuro\b|\bpound\b|\boil (?:prices?|markets?|output|supplies|supply|demand|production)\b|\bcrude\b|\bbrent\b|\bopec\b|\bnatural gas\b|\bwti\b|\bnasdaq\b|\bdow jones\b|\bs&p 500\b|\bwall street\b|\bstock market\b|\bnifty\b|\bsensex\b"
NOISE = r"\bdeclares? (?:quarterly |monthly |special )?(?:distribution|dividend)\b|\bgoes? ex-dividend\b|\bdividend (?:declared|yield|per share)\b|\b(?:stock|shares?) (?:hits?|rise|rises|fall|falls|jumps?|slides?) (?:to )?(?:52-week|all-time|record)\b|\bhits? (?:52-week|all-time) (?:high|low)\b|\binsider (?:trading|selling|buying)\b|\b(?:sells?|sold|buys?) [\d.,]+ ?(?:m|million|k)? ?(?:shares?|stock)\b|\bfiles? (?:confidentially )?for (?:an? )?ipo\b|\bquarterly earnings\b|\b(?:director|ceo|cfo) .{0,30}(?:sells?|buys?) [\d,]+ shares\b|\bannual meeting\b|\bprice target\b"
SPORTS = r"\b(?:asian games|asiad|olympi\w*|medals?\b|fencing|sabre\b|epee\b|handball|skateboarding|equestrian|dressage|synchroni[sz]ed (?:diving|swimming)|\bdivers\b|weightlifting|world cup|championship\w*|grand prix|super bowl|(?:wins?|won|claims?|claimed|captures?|captured|grabs?|grabbed|bags?|bagged|nabs?|nabbed|secures?|secured) (?:the )?(?:gold|silver|bronze)|(?:gold|silver|bronze) medal|\b(?:women|men|mixed)[-' ](?:team|event|singles|doubles|relay|final)\b)"
HARD_NOISE = r"\b(?:top |best )?(?:stocks?|shares?) to buy\b|\btop stocks\b|\bstock picks?\b|\bstock selection\b|\btarget,? sl\b|\bbuy points?\b|\bpicks? \d+ stocks\b|\braise stakes in \d+ stocks\b|\bshare price\b|\bdrhp\b|\bfresh issue\b|\bipo (?:papers?|filing|stock)\b|\bfiles? (?:for (?:an? )?)?(?:draft )?(?:red herring )?prospectus\b|\bgoes? ex-dividend\b|\bdividend (?:declared|yield|per share)\b|\binsider (?:trading|selling|buying)\b|\bannual meeting\b|\bhits? (?:52-week|all-time) (?:high|low)\b"

#: Asset aliases, importance of calendar events.
ALIASES = {"GOLD": "XAU", "SILVER": "XAG", "OIL": "WTI"}
IMPORTANCE = {"High": 0, "Medium": 1, "Low": 2}
