"""Terms of urls that a text corpus leaves out, by language and weight: strict ones block alone, soft ones only together."""

from __future__ import annotations

STRICT, SOFT, WEAK = 1.0, 0.5, 0.34

_STRICT = {
    "en": "adult bdsm blackjack camgirl camgirls casino cialis counterfeit cumshot darknet doorway escort escorts fetish gambling hardcore hentai "
    "keylogger levitra malware milf nsfw onlyfans payday phishing phentermine porn porno pornography pornstar ransomware roulette sex sexcam "
    "sexcams sextoy sexy slut spam spamming spyware stripper swingers threesome trojan tramadol valium viagra warez webcamsex xanax xxx",
    "de": "bordell erotik erotikchat fickdate gluecksspiel huren nacktbilder nutten onlinecasino pornofilme pornos raubkopien seitensprung "
    "sexchat sexdate sexkontakte sextreffen spielautomaten spielhalle sportwetten telefonsex wettanbieter",
    "fr": "cocufier echangisme escorte jeuxdargent libertin libertinage machineasous pornographie pornographique prostituee putes sexe sexuelles "
    "sexuels videoporno",
    "es": "apuestas apuestasdeportivas burdel cachondas desnudas escortes esposasinfieles follar maduras pornografia prostitutas putas ruleta "
    "tragaperras tragamonedas videosporno xvideos",
}
_SOFT = {
    "en": "bet bets betting bingo bonus cheap clickbait crack cracked crypto dating debt discreet download downloads farm flirt forex free "
    "giveaway hack hacked hookup hot instantly jackpot keygen lingerie loan loans lottery lotto mature miracle naked nude nudes odds offshore "
    "pharmacy pills poker prescription promo proxy refinance replica replicas scam seo serial singles slots steroids stream "
    "streams supplements sweepstakes tabloid teen teens tipster torrent torrents unblocked unlimited win winner",
    "de": "abnehmen abzocke billig flirten gewinnen gewinnspiel gratis heimarbeit kasino kredit kredite nackt partnersuche partnervermittlung "
    "pillen potenzmittel rabatt reich schnaeppchen schuldenfrei sofortkredit wette wetten",
    "fr": "argent cadeau celibataires gagner gratuit gratuits maigrir nue nues parier pilules rencontre rencontres telecharger",
    "es": "adelgazar barato baratos bono chicas descargar desnudo dinero ganar gratuito ligar loteria pastillas premio prestamo prestamos "
    "quiniela solteras sorteo",
}
_WEAK = {
    "en": "ads affiliate buy click coupon coupons deal deals discount earn gift guaranteed income offer offers online popup "
    "rewards sale shop subscribe trial vip voucher",
    "de": "angebot angebote gewinn gutschein gutscheine kaufen rabatte verdienen",
    "fr": "acheter offre offres remise soldes",
    "es": "comprar descuento descuentos oferta ofertas rebajas",
}
#: term -> weight; a term of several languages has the largest of its weights
TERMS: dict[str, float] = {}
for _weight, _words in ((WEAK, _WEAK), (SOFT, _SOFT), (STRICT, _STRICT)):
    for _language in _words.values():
        TERMS.update(dict.fromkeys(_language.split(), _weight))
