"""Natural language hidden inside code (problem 2).

Per-language lexers give the comments and string literals of a file; comments that follow one another are one text.
Code-like lines, queries, paths, keys, directives and bare tags are taken out, the rest is cut into sentences of at
least five words (eight characters in Chinese and Japanese). A naive Bayes model over character n-grams (1 to 3,
hashed) names the language of each sentence, without looking at identifiers; its characters count for the file.

The model is trained on bundled sentences and on about ``TRAIN`` documents with a language label (never more than
twice as many), sampled by a hash of their id; labels are trimmed, lower-cased and cut to two letters, so wrong ones are a minority.

Defined results: one row per file and language with text; null content and docstrings count as absent; a file with no
text has no row; repeated rows and lines count once; a docstring counts only if its words do not stand in a content of
the file. Files are read whole. Paths with an unknown extension and null paths are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.grammars import lexers
from quern.llm.blocks import per_block
from quern.llm.common import bounded_sample
from quern.llm.functions import _CJK, _DIRECTIVE, _MARK, _TAG, code_like
from quern.llm.parsing import assemble, files

LANGS = ("en", "de", "fr", "es", "pt", "it", "ru", "zh", "ja")
TRAIN = 3000  # labelled documents
BUCKETS = 1 << 15

# Sentences to start the model with.
SEED = {
    "en": "The function returns the first value that was found in the list, or nothing if the list is empty. We should not change this because other callers still depend on the order of the rows. When the file has been read, its contents are kept in memory until the next run starts. This part of the code waits for the lock and then removes everything that is older than one hour, so please be careful with it.",
    "de": "Die Funktion gibt den ersten Wert zurück, der in der Liste gefunden wurde, oder nichts, wenn die Liste leer ist. Wir sollten das nicht ändern, weil andere Aufrufer noch von der Reihenfolge der Zeilen abhängen. Sobald die Datei gelesen wurde, bleibt ihr Inhalt bis zum nächsten Lauf im Speicher. Dieser Teil wartet auf die Sperre und löscht danach alles, was älter als eine Stunde ist, also bitte vorsichtig damit umgehen und nicht von Hand bearbeiten.",
    "fr": "La fonction renvoie la première valeur trouvée dans la liste, ou rien si la liste est vide. Il ne faut pas changer cela, car d'autres appels dépendent encore de l'ordre des lignes. Quand le fichier a été lu, son contenu reste en mémoire jusqu'au prochain lancement. Cette partie attend le verrou puis supprime tout ce qui date de plus d'une heure, même si cela prend du temps, afin que les résultats soient toujours les mêmes.",
    "es": "La función devuelve el primer valor que se encontró en la lista, o nada si la lista está vacía. No debemos cambiar esto porque otras llamadas todavía dependen del orden de las filas. Cuando se ha leído el archivo, su contenido permanece en la memoria hasta la próxima ejecución. Esta parte espera el bloqueo y luego borra todo lo que tiene más de una hora, así que hay que tener cuidado con ella mientras no haya una solución mejor.",
    "pt": "A função devolve o primeiro valor que foi encontrado na lista, ou nada se a lista estiver vazia. Não devemos mudar isso porque outras chamadas ainda dependem da ordem das linhas. Quando o arquivo foi lido, o seu conteúdo fica na memória até a próxima execução. Esta parte espera pelo bloqueio e depois apaga tudo o que tem mais de uma hora, por isso é preciso ter cuidado com ela enquanto não houver uma solução melhor.",
    "it": "La funzione restituisce il primo valore che è stato trovato nella lista, oppure niente se la lista è vuota. Non dobbiamo cambiare questo perché altre chiamate dipendono ancora dall'ordine delle righe. Quando il file è stato letto, il suo contenuto resta in memoria fino alla prossima esecuzione. Questa parte aspetta il blocco e poi cancella tutto ciò che ha più di un'ora, quindi bisogna fare attenzione finché non troviamo una soluzione migliore.",
    "ru": "Функция возвращает первое значение, которое нашлось в списке, или ничего, если список пуст. Мы не должны это менять, потому что другие вызовы всё ещё зависят от порядка строк. Когда файл прочитан, его содержимое остаётся в памяти до следующего запуска. Эта часть ждёт блокировку и потом удаляет всё, что старше одного часа.",
    "zh": "这个函数返回列表里找到的第一个值，如果列表为空就不返回任何内容。我们不应该修改它，因为其他调用仍然依赖行的顺序。文件读完以后，内容会留在内存里，直到下一次运行开始。这部分代码会等待锁，然后删除一小时以前的所有数据，请小心处理。",
    "ja": "この関数はリストの中で最初に見つかった値を返し、リストが空のときは何も返しません。ほかの呼び出しがまだ行の順番に依存しているので、これを変えてはいけません。ファイルを読んだあと、その内容は次の実行までメモリに残ります。この部分はロックを待ってから、一時間より古いものをすべて消します。",
}

_IDENT = re.compile(r"[A-Za-z0-9$]*(?:[a-z0-9][A-Z_]|_|\d)[A-Za-z0-9_$]*|[\w.-]*/[\w./-]+|`[^`]*`")
_LETTERS = re.compile(r"[^\W\d_]+")


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram (n = 1, 2, 3) of each text and the offset of each text."""
    joined = "".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c)
    row = np.repeat(np.arange(len(texts)), size)
    parts, rows = [], []
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, 4):
            if n < k:
                break
            h = h[: n - k + 1] * np.uint64(1_000_003) + c[k - 1 :]
            ok = row[: n - k + 1] == row[k - 1 :]
            x = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            parts.append((x >> np.uint64(49)).astype(np.int64)[ok])
            rows.append(row[: n - k + 1][ok])
    g, r = np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate(rows) if rows else np.zeros(0, np.int64)
    order = np.argsort(r, kind="stable")
    return g[order], np.searchsorted(r[order], np.arange(len(texts) + 1))


def _plain(text: str) -> str:
    """Lower-case words of a sentence without its identifiers, with a blank around each."""
    return " " + " ".join(_LETTERS.findall(_IDENT.sub(" ", text))).lower() + " "


def fit(labelled: list[tuple[str, str]]) -> np.ndarray:
    """Log probabilities (BUCKETS, languages) from (language, text); the bundled sentences count like 20 copies each."""
    counts = np.full((BUCKETS, len(LANGS)), 0.05)
    for lang, text in [(k, v) for k, v in SEED.items() for _ in range(20)] + labelled:
        if lang in LANGS:
            g, _ = _grams([_plain(text)])
            np.add.at(counts[:, LANGS.index(lang)], g, 1.0)
    return np.log(counts / counts.sum(0)).astype(np.float32)


def train(documents: DataFrame) -> np.ndarray:
    """The model, from a bounded sample of labelled documents."""
    lang = F.substring(F.lower(F.regexp_replace("lang", r"^\s+", "")), 1, 2)
    part = (
        documents.filter("text is not null and lang is not null and (text_format is null or text_format <> 'source')")
        .select("doc_id", lang.alias("lang"), "text").filter(F.col("lang").isin(*LANGS))
    )
    rows = bounded_sample(part, "doc_id", TRAIN).collect()
    labelled = []
    for r in rows:
        for s in sentences_of("\n".join(x for x in r.text.split("\n") if not code_like(x))):
            # Commands and names are English in any document; a script settles the rest.
            if r.lang == "en" or r.lang in ("ru", "zh", "ja") and re.search("[Ѐ-ӿ぀-ヿ一-鿿]", s) or r.lang not in ("en", "ru", "zh", "ja"):
                labelled.append((r.lang, s))
    return fit(_self_cleaned(labelled))


def _self_cleaned(labelled: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Sentences whose label the bundled model does not clearly contradict."""
    if not labelled:
        return []
    best = classify([s for _, s in labelled], fit([]))
    return [x for x, b in zip(labelled, best) if x[0] == LANGS[b]]


def classify(sentences: list[str], model: np.ndarray) -> np.ndarray:
    """Index of the language of each sentence."""
    if not sentences:
        return np.zeros(0, np.int64)
    g, off = _grams([_plain(s) for s in sentences])
    return np.add.reduceat(model[g], off[:-1], axis=0).argmax(1)


_SPLIT = re.compile(r"(?<=[.!?])\s+(?=\S)|(?<=[。！？])")
_WORDS = re.compile(r"[^\W\d_][\w'’-]*")
_QUERY = re.compile(r"^\s*(?:SELECT\b.*\bFROM\b|INSERT INTO\b|UPDATE\b.*\bSET\b|DELETE FROM\b|CREATE (?:TABLE|INDEX|VIEW)\b|ALTER TABLE\b|DROP TABLE\b|WITH\b.*\bAS\s*\()", re.S)


def sentences_of(text: str) -> list[str]:
    """Sentences of at least five words or eight Chinese or Japanese characters."""
    out = []
    for s in _SPLIT.split(text):
        s = s.strip()
        if len(_CJK.findall(s)) >= 8 or len(_WORDS.findall(s)) >= 5 and re.search(r"[^\W\d_]{2}", _IDENT.sub(" ", s)):
            out.append(s)
    return out


def _comment_text(comment: str) -> str:
    """Prose of a run of comments, lines joined by blanks; an empty line or a tag starts a new sentence."""
    out: list[str] = []
    for line in comment.split("\n"):
        line = _MARK.sub("", _MARK.sub("", line)).strip()
        tagged = False
        while (m := _TAG.match(line)) and m.end():
            line = line[m.end() :].strip()
            tagged = True
        if not re.search(r"\w", line) or code_like(line) or _DIRECTIVE.match(line):
            out.append("\n")
            continue
        out.append(("\n" if tagged else " ") + line)
    return "".join(out)


def _prose(comment: str) -> list[str]:
    return [s for part in _comment_text(comment).split("\n") for s in sentences_of(part)]


_ESCAPE = re.compile(r"\\[nrt]")


def _string_prose(lang: str, token: str) -> list[str]:
    body = re.sub(r"^[A-Za-z]{0,3}#*(\"\"\"|'''|[\"'`])([\s\S]*?)\1#*$", r"\2", token)
    if " " not in body and not _CJK.search(body) or _QUERY.match(body):
        return []
    if lang == "python" and token.lstrip("rRuUbB")[:3] in ('"""', "'''"):
        return _prose(body)
    return [s for line in _ESCAPE.sub("\n", body).split("\n") if not code_like(line) for s in sentences_of(line)]


_GAP = re.compile(r"[ \t]*\n?[ \t]*")
_NONWORD = re.compile(r"[\W_]+")


def file_sentences(lang: str, text: str) -> list[str]:
    """The sentences in the comments and strings of a file."""
    out: list[str] = []
    run: list[str] = []
    last = -1
    for kind, a, b in lexers.pieces(lang, text):
        if run and not (kind == "c" and _GAP.fullmatch(text, last, a) and text.count("\n", last, a) == 1):
            out += _prose("\n".join(run))
            run = []
        if kind == "c":
            run.append(text[a:b])
            last = b
        else:
            out += _string_prose(lang, text[a:b])
    if run:
        out += _prose("\n".join(run))
    return out


def shares(chunks: DataFrame, model: np.ndarray) -> DataFrame:
    """(file_path, lang, chars, bytes, file_chars, share, byte_share) for every file and language with text; bytes are those of
    UTF-8, and ``byte_share`` is their part of the bytes of the file."""

    def run(t: pa.Table) -> pa.Table:
        paths, sizes, widths, owner, text_of = [], [], [], [], []
        for i, (path, lang, parts) in enumerate(zip(*(t.column(c).to_pylist() for c in ("file_path", "lang", "parts")))):
            text = assemble([(p["start"], p["content"]) for p in parts])
            found = file_sentences(lang, text)
            size, width = len(text), len(text.encode("utf-8", "replace"))
            docs = sorted({p["docstring"] for p in parts if p["docstring"]})
            if docs:
                words = _NONWORD.sub("", text)
                for d in docs:
                    if _NONWORD.sub("", d) not in words:
                        size += len(d)
                        width += len(d.encode("utf-8", "replace"))
                        found += _prose(d)
            paths.append(path)
            sizes.append(size)
            widths.append(width)
            owner += [i] * len(found)
            text_of += found
        best = classify(text_of, model)
        chars = np.zeros((len(paths), len(LANGS)), np.int64)
        np.add.at(chars, (np.array(owner, np.int64), best), np.fromiter(map(len, text_of), np.int64, len(text_of)))
        octets = np.zeros_like(chars)
        np.add.at(octets, (np.array(owner, np.int64), best), np.fromiter((len(s.encode("utf-8", "replace")) for s in text_of), np.int64, len(text_of)))
        i, k = np.nonzero(chars)
        size, width = np.array(sizes, np.int64)[i], np.array(widths, np.int64)[i]
        return pa.table(
            {
                "file_path": pa.array([paths[x] for x in i], pa.string()), "lang": pa.array([LANGS[x] for x in k], pa.string()),
                "chars": chars[i, k], "bytes": octets[i, k], "file_chars": size, "share": chars[i, k] / np.maximum(size, 1), "byte_share": octets[i, k] / np.maximum(width, 1),
            }
        )

    return files(chunks, "docstring").mapInArrow(per_block(run, 16 << 20), "file_path string, lang string, chars bigint, bytes bigint, file_chars bigint, share double, byte_share double")
