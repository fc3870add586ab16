"""Languages of words by their characters: log-ratios of n-grams, learned from frequent words and then from the texts at hand."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

# Frequent words and numerals of six languages, from which learning starts. They are not looked up afterwards.
FREQUENT = {
    "en": """the of and is are was were be been to in at on for that with from by it its this these what how many much which who he she they we you have has had
        not no none all but or if then than so because before after more most only other some any each every there here now also first next gives after step total
        number real solution undefined them can cannot could would should i my your help question task find out work answer result final hence therefore
        one two three four five six seven eight nine ten eleven twelve thirteen fifteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand half third quarter""",
    "de": """der die das des dem den ein eine einen einem einer und ist sind war es von zu mit für auf im am aus nach bei nicht noch wie viele wenn dann weil oder
        also ergibt sich daraus folgt zuerst rechnen wir diesem schritt antwort ergebnis lautet keine kein lösung möglich davon stück dabei jetzt bleiben insgesamt
        ich kann diese frage leider hat übrig alle mehr weniger halb hälfte drittel viertel eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn
        zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig einundzwanzig hundert tausend""",
    "fr": """le la les un une des du de et est sont il elle à au aux en dans pour sur avec que qui ne pas plus combien cette ce on donc si alors parce ou où
        obtient cela donne après étape calcule abord réponse résultat aucune aucun valeur possible reste tous toutes moins encore je peux désolé question
        moitié tiers quart un deux trois quatre cinq six sept huit neuf dix onze douze treize quinze seize vingt trente quarante cinquante soixante cent mille""",
    "es": """el la los las un una unos unas del de y es son en para por con que no se al cuántas cuántos esta este hay más menos si entonces porque o donde
        resulta primero calculamos después paso respuesta resultado ningún ninguna valor posible total quedan todos todas puedo ayudar pregunta
        mitad tercio cuarto uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece quince veinte treinta cuarenta cincuenta sesenta cien ciento mil""",
    "ru": """и в не на я что он с как это по но они мы все она так его за было только еще от когда уже для вот да нет же если или сколько осталось всего
        ответ результат решение получаем сначала затем потом после теперь стало значит вычислим шаг число больше меньше половина треть
        один два три четыре пять шесть семь восемь девять десять двадцать тридцать сорок пятьдесят сто тысяча""",
    "zh": """的 是 在 了 和 有 不 我们 这 个 多少 一共 还 剩 下 首先 然后 所以 答案 结果 计算 得到 没有 可能 步 数 更多 更少 一半 三分之一 因为 如果 那么
        一 二 三 四 五 六 七 八 九 十 百 千""",
}
NAMES = tuple(FREQUENT)
_BITS, _ORDERS = 16, 4
#: How often the word itself counts beside its n-grams.
_WHOLE = 4
#: Chance that a word stands in any text, whatever its language.
_FLOOR = 0.03


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, hashed n-gram) for the n-grams of up to four characters of each word between its bounds, and for the word itself."""
    codes = np.frombuffer(("\x02" + "\x02".join(words) + "\x02").encode("utf-32-le", "surrogatepass"), np.uint32)
    bound = np.flatnonzero(codes == 2)
    owner = np.searchsorted(bound, np.arange(len(codes)), "right") - 1
    end = np.append(bound[1:], len(codes))[np.minimum(owner, len(bound) - 1)]
    places, found, h = [], [], codes.copy()
    for n in range(1, _ORDERS + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        at = np.arange(len(h))
        inside = (at + n - 1 <= end[at]) & (owner[at] < len(words)) & ((codes[at] != 2) | (n > 1))
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)
        places.append(owner[at][inside])
        found.append((mixed[inside] >> np.uint32(32 - _BITS)).astype(np.int64))
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) >> (32 - _BITS) for w in words], np.int64)
    for _ in range(_WHOLE):
        places.append(np.arange(len(words)))
        found.append(whole)
    return np.concatenate(places), np.concatenate(found)


class Languages:
    """`table`: for each n-gram and language, its log-likelihood less the mean over the languages."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def fit(cls, weights: dict[str, np.ndarray], smooth: float = 0.3) -> Languages:
        """From words and how much each speaks for each language."""
        words = [w for w in weights if w]
        owner, gram = _grams(words)
        share = np.stack([weights[w] for w in words])
        counts = np.stack([np.bincount(gram, weights=share[owner, k], minlength=1 << _BITS) for k in range(len(NAMES))], axis=1) + smooth
        likely = np.log(counts / counts.sum(axis=0))
        return cls((likely - likely.mean(axis=1, keepdims=True)).astype(np.float32))

    def scores(self, words: list[str]) -> np.ndarray:
        """The logarithm of each word's chance by language, from the sum over its n-grams; n-grams overlap, so the sum counts by its root.

        A floor keeps any one word, such as a name, from outweighing several others.
        """
        if not words:
            return np.zeros((0, len(NAMES)), np.float32)
        owner, gram = _grams(words)
        order = np.argsort(owner, kind="stable")
        owner, gram = owner[order], gram[order]
        out = np.zeros((len(words), len(NAMES)), np.float32)
        if len(owner):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(start, len(owner)))[:, None]
            total = np.add.reduceat(self.table[gram], start, axis=0) / np.sqrt(size)
            chance = np.exp(total - total.max(axis=1, keepdims=True))
            out[owner[start]] = np.log(_FLOOR + chance / chance.sum(axis=1, keepdims=True))
        return out


def learn(texts: list[list[str]], rounds: int = 2) -> Languages:
    """Languages from the frequent words, then from the words of the texts too.

    Each round tells the language of every text that shows one clearly; a word seen in two texts or more then counts for the
    languages in the shares in which it occurs in them, so that names used everywhere speak for none.
    """
    seeds: dict[str, np.ndarray] = {}
    for k, listed in enumerate(FREQUENT.values()):
        for word in listed.split():
            seeds.setdefault(word, np.zeros(len(NAMES)))[k] += 1
    seeds = {w: v / v.sum() for w, v in seeds.items()}
    found = Languages.fit(seeds)
    distinct = [sorted({w for w in t if not w.isdigit()}) for t in texts]
    vocabulary = sorted({w for t in distinct for w in t})
    place = {w: i for i, w in enumerate(vocabulary)}
    for _ in range(rounds if vocabulary else 0):
        score = found.scores(vocabulary)
        seen: list[Counter] = [Counter() for _ in NAMES]
        for t in distinct:
            if t:
                total = score[[place[w] for w in t]].sum(axis=0)
                first, second = np.sort(total)[::-1][:2]
                if first - second > 3:
                    seen[int(total.argmax())].update(t)
        size = np.array([max(1, sum(c.values())) for c in seen])
        weights = dict(seeds)
        for word in {w for c in seen for w in c}:
            n = np.array([c[word] for c in seen])
            if n.sum() > 1:
                rate = n / size
                weights[word] = 2 * seeds.get(word, 0) + rate / rate.sum()
        found = Languages.fit(weights)
    return found
