"""Defaults of the engine; every function takes other values as arguments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

# The default lexicon of the keyword filter.
KEYWORDS = (
    "заработ", "удалёнк", "удаленк", "казино", "ставк", "выигр", "доход", "работ на дому", "пассивный доход", "быстрые деньги", "инвестиц", "крипт", "трейд", "млм", "сетевой маркетинг",
)
PATTERNS = (
    r"\$\d+", r"\d+\$", r"\d+\s*долларов", r"\d+\s*руб", r"https?://bit\.ly/", r"https?://t\.me/[a-zA-Z0-9_]+", r"\+\d{10,15}", r"пиши\s+[+«\"']", r"жми\s+сюда", r"переходи\s+по\s+ссылке",
)
# Terms of shops and of orders, substrings of lower-cased text.
STORE_TERMS = (
    "магазин", "магаз", "товар", "продук", "ассортимент", "наличи", "склад", "поступление", "новинк", "коллекц", "каталог", "цена", "стоимост", "прайс", "скидк", "акци", "распродаж",
    "купить", "заказ", "доставк", "самовывоз", "оплат", "размер", "цвет", "модел", "бренд", "производител", "интернет-магазин", "сайт", "корзин", "оформ", "чек", "гарантия", "возврат", "обмен", "качеств",
)
ORDER_TERMS = (
    "заказ", "меню", "блюд", "порци", "доставка еды", "ресторан", "кафе", "пицц", "суши", "ролл", "бургер", "салат", "напиток", "завтрак", "обед", "ужин", "комбо", "сет",
    "адрес доставки", "время доставки", "курьер", "оплата при получении", "услуг", "запись", "сеанс", "мастер", "специалист", "консультац", "расписани", "график работы", "прием", "бронирован",
)
#: The names of one's own brands.
BRAND_TERMS = ("acmeshop",)

SPAM_FAMILIES = ("recruiting", "gambling", "loans", "get_rich", "dayjob", "illegal_docs", "gray_biz")
LEGIT_FAMILIES = ("store_promo", "giveaway_own", "order_flow", "service_info")
MODES = ("manual", "semi-auto", "auto", "legacy-manual")


@dataclass(frozen=True)
class Policy:
    """Thresholds on the spam probability and multipliers that lower it.

    Those that may be overridden at run time can be columns as well."""

    mode: str | Column = "semi-auto"
    notify: float | Column = 0.65
    delete: float | Column = 0.85
    kick: float | Column = 0.95
    announcement: float | Column = 0.85
    reply_to_staff: float | Column = 0.90
    whitelist: float | Column = 0.85
    brand: float = 0.70
    degraded_step: float = 0.05
    legacy_keyword: float = 0.60
    legacy_tfidf: float = 0.65


#: Settings that may be overridden at run time, with their kinds.
SETTINGS: dict[str, object] = {
    "policy_mode": "semi-auto", "meta_notify": 0.65, "meta_delete": 0.85, "meta_kick": 0.95,
    "meta_downweight_announcement": 0.85, "meta_downweight_reply_to_staff": 0.90, "meta_downweight_whitelist": 0.85,
}
CHAT_HISTORY, CHAT_CONTEXT = 12, 4
USER_HISTORY, USER_CONTEXT = 10, 5
CONTEXT_CHARS, USER_CHARS, USER_MESSAGE_CHARS = 512 * 4, 512, 100
