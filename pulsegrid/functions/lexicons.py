"""Word lists, factors and thresholds. All are defaults: every function that uses one takes another as a parameter."""

# --- Fixed values -----------------------------------------------------------------------------------------------------

SPAM = ["bet", "casino", "bonus", "çevrimsiz", "yatırımsız", "deneme bonusu", "yasal bahis", "slot", "rulet", "reklam", "tıkla", "linkte", "kazan"]
JUNK = ["burç", "fal ", "günlük burç", "astroloji", "horoskop", "astrolog"]
HIDDEN = ["burç", "fal ", "günlük burç", "astroloji", "horoskop"]

CRITICAL_HIGH = ["deprem", "patlama", "istifa", "suikast", "darbe", "saldırı", "acil durum", "infaz", "terör", "faci", "şehit"]
CRITICAL_MEDIUM = ["faiz kararı", "seçim", "gözaltı", "operasyon", "flaş haber", "son dakika", "kararname"]

TIER_1 = ["AA", "Anadolu Ajansı", "TRT", "DHA", "IHA", "ANKA"]
TIER_2 = ["Sözcü", "Hürriyet", "Habertürk", "Cumhuriyet", "Milliyet", "T24"]
TIER_WEIGHTS = {1: 1.25, 2: 1.00, 3: 0.75}

CATEGORIES = ["Siyaset", "Ekonomi", "Gündem", "Spor", "Teknoloji", "Sanat"]
DECAY = {"Siyaset": 0.98, "Ekonomi": 0.97, "Teknoloji": 0.94, "Gündem": 0.92, "Spor": 0.85, "Sanat": 0.88}
DECAY_OTHER = 0.93
CATEGORY_ICONS = {"Siyaset": "🏛️", "Ekonomi": "💰", "Spor": "⚽", "Teknoloji": "💻", "Sanat": "🎨", "Gündem": "📢"}

LEVEL_WEIGHTS = {"high": 60, "medium": 20, "low": 5}
SPORTS = {
    "high": ["futbol", "süper lig", "şampiyonlar ligi", "avrupa ligi", "beşiktaş", "fenerbahçe", "galatasaray", "trabzonspor", "milli takım", "voleybol", "basketbol", "derbi", "puan durumu", "teknik direktör", "gol kralı", "fikstür"],
    "medium": ["penaltı", "transfer", "kadro", "madalya", "şampiyon", "kupa", "bonservis", "sarı kart", "kırmızı kart", "ofsayt", "var incelemesi"],
    "low": ["maç", "skor", "takım", "kulüp", "hakem", "oyuncu", "antrenman", "karşılaşma"],
}
ECONOMY = {
    "high": ["enflasyon", "faiz", "zam", "maaş", "borsa istanbul", "bist 100", "tcmb", "merkez bankası", "dolar/tl", "euro/tl", "akaryakıt", "halka arz", "asgari ücret", "emekli zammı", "vergi artışı"],
    "medium": ["tüfe", "üfe", "ihracat", "ithalat", "gsyh", "kredi", "vergi", "bütçe", "cari açık", "döviz kuru", "altın fiyatları", "temettü", "spk", "kap"],
    "low": ["fiyat", "artış", "yatırım", "borç", "şirket", "piyasa", "kar", "zarar", "maliyet", "tüketici", "alım gücü"],
}
TECHNOLOGY = {
    "high": ["apple", "google", "microsoft", "openai", "chatgpt", "yapay zeka", "ai", "siber güvenlik", "baykar", "tusaş", "aselsan", "uzay", "roket", "savunma sanayii", "togg", "insansız hava aracı"],
    "medium": ["yazılım", "donanım", "ios", "android", "akıllı telefon", "işlemci", "güncelleme", "robot", "drone", "uygulama", "blockchain", "kripto para", "bulut bilişim"],
    "low": ["cihaz", "teknoloji", "dijital", "platform", "şifre", "bağlantı", "hız", "ekran", "fiber", "internet"],
}
POLITICS = {
    "high": ["cumhurbaşkanı", "erdoğan", "özgür özel", "bahçeli", "imamoğlu", "ak parti", "chp", "mhp", "tbmm", "meclis", "başkan", "kabine", "seçim", "ysk", "anayasa", "bakanlığı"],
    "medium": ["miting", "aday", "ittifak", "yasa", "kanun", "zirve", "diplomasi", "nato", "bm", "birleşmiş milletler", "istifa", "gözaltı", "tutuklama", "önerge"],
    "low": ["açıklama", "toplantı", "karar", "kriz", "gündem", "lider", "tepki", "eleştiri", "ziyaret", "diplomatik"],
}
ART = {
    "high": ["sinema", "film", "dizi", "konser", "festival", "sergi", "kitap", "yazar", "oyuncu", "albüm", "tarkan", "sezen aksu", "magazin", "ünlü", "cem yılmaz"],
    "medium": ["vizyon", "gala", "sahne", "yönetmen", "fragman", "reyting", "aşk", "ayrılık", "boşanma", "evlilik", "fenomen", "sosyal medya", "instagram"],
    "low": ["izle", "dinle", "eğlence", "moda", "tarz", "trend", "stil", "kırmızı halı", "tiktok", "paylaşım"],
}
GENERAL = {
    "high": ["deprem", "yangın", "kaza", "sel", "cinayet", "operasyon", "patlama", "afad", "polis", "jandarma", "meteoroloji", "şiddetli fırtına"],
    "medium": ["vefat", "kayıp", "arama kurtarma", "trafik kazası", "gözaltı", "adliye", "asayiş", "uyarı", "don", "sağanak"],
    "low": ["haber", "olay", "hava durumu", "sıcaklık", "belediye", "valilik", "hizmet", "duyuru"],
}
#: In this order ties are settled.
LEXICON = {"Spor": SPORTS, "Ekonomi": ECONOMY, "Teknoloji": TECHNOLOGY, "Siyaset": POLITICS, "Sanat": ART, "Gündem": GENERAL}

#: In this order rules apply: words, then (penalty, categories) pairs.
PENALTIES = [
    (["galatasaray", "fenerbahçe", "beşiktaş", "trabzonspor", "süper lig", "maç", "gol", "transfer"], [(-60, ["Siyaset"])]),
    (["deprem", "yangın", "sel", "kaza", "can kaybı", "patlama"], [(-40, ["Siyaset", "Ekonomi"])]),
    (["resmi gazete", "kararname", "kanun teklifi", "tbmm", "anayasa mahkemesi", "genel kurul", "grup toplantısı"], [(-50, ["Spor", "Sanat", "Teknoloji", "Gündem"]), (-20, ["Ekonomi"])]),
    (["borsa istanbul", "bist 100", "döviz kuru", "faiz kararı", "enflasyon rakamları", "temettü", "kap bildirimi"], [(-40, ["Spor", "Sanat", "Teknoloji"]), (-15, ["Siyaset", "Gündem"])]),
]

ALERT_AT, PUBLISH_AT, INDEX_AT = 20.0, 35.0, 25.0
