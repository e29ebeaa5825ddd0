r"""E-mails reduced to the lines that their senders newly wrote.

Method: every line of every mail is exploded and normalised (quote marks, soft breaks, spaces and case taken off), and
windows over the lines of a thread, of a sender and of a mail tell what is new.

1. *Thread window.* The mails of a thread (same subject without reply prefixes) are ranked by date; of equal lines the one
   in the first mail is the authored one. In other mails such a line is retold: if it has a quote mark or stands in an
   older message, whoever wrote it; if it stands free, when somebody else wrote it first and it is long enough
   (``FREE`` characters) not to be a greeting or a phrase.
2. *Sender window.* A line of the closing part of a mail is recurrent if the same sender has it in ``THREADS`` threads or
   more. Closing parts begin at a closing formula, signature mark, device line, legal notice or the sender's name (mail
   window); besides, a short last line without one of these is recurrent if it ends mails of the sender in three threads.
3. *Mail window*, for lines whose earlier mail or recurrence isn't in the collection. The header block ends at the first
   empty line. A line that opens an earlier message (separator or header lines without quote marks) makes everything
   after it old. Lines with quote marks (``>``, ``|``, initials and ``>``) are old, as are the lines that introduce them
   and, after an introduction that is followed by indented lines, those that are indented. What stands between quoted
   passages without a mark is a reply in place, so it is new. Closing parts are left out, whether recurrent or not.

``reasons`` gives for each line the first of these that applies, so the share of each step can be counted.

Scale: a mail's lines are one window, bounded by the mail. The ranks within a thread and the recurrence of a sender are
least values and counts of (thread, line) and (sender, line), which are aggregated partially before the shuffle, so neither
a busy sender nor a subject that many mails share brings its lines into one task. Lines move as hashes.

Defined results: null and empty texts give no line; lines of white space are never given; CR at a line's end doesn't
count; replayed mails count once by key; in a mail without an empty line only lines that look like header lines are such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: A free line of at least so many characters can be known as somebody else's.
FREE = 40
#: Threads in which a sender has a line of a closing part that is recurrent.
THREADS = 2
#: Words of four languages that mail programs use.
HEADER = r"^\W{0,3}(?:From|Von|De|Sent|Gesendet|Envoy[ée]|Enviado(?: el)?|To|An|À|A|Para|Cc|Kopie|Subject|Betreff|Objet|Asunto|Date|Datum|Fecha)\*?\s?:"
SENDER = r"^\W{0,3}(?:From|Von|De)\*?\s?:"
SEPARATOR = r"(?i)^\s*(?:[-_=*]{3,}[ \t]*(?:original message|forwarded message|forwarded by .{1,40}|urspr[üu]ngliche nachricht|weitergeleitete nachricht|message d.origine|message transf[ée]r[ée]|mensaje original|mensaje reenviado)[ \t]*[-_=*]{3,}|begin forwarded message:|d[ée]but du message (?:transf[ée]r[ée]|r[ée]exp[ée]di[ée]).*|anfang der weitergeleiteten nachricht:?|inicio del mensaje reenviado:?)\s*$"
RULE = r"^\s*_{10,}\s*$"
QUOTE = r"^[ \t]{0,12}(?:\p{Lu}\p{L}{0,2}>|[>|])"
#: All quote marks of a line.
MARKS = r"^(?:[ \t]{0,12}(?:\p{Lu}\p{L}{0,2}>|[>|])[ \t]?)+"
DATE = r"(?:\d{1,2}\.?[ \t]+\p{L}{3,10}\.?[ \t]+\d{4}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{2}-\d{2})"
TIME = r"\d{1,2}[:h]\d{2}"
WROTE = r"(?:wrote|schrieb|a écrit|escribió)"
CLOSING = r"(?i)^\s*(?:(?:with )?(?:best|kind|kindest|warm) (?:regards|wishes)|regards|br|kr|cheers|many thanks(?: and best wishes)?|(?:many )?thanks|thank you|thx|yours(?: (?:sincerely|faithfully|truly))?|sincerely(?: yours)?|(?:mit )?(?:freundlichen|besten|herzlichen|lieben) gr(?:ü|ue)(?:ß|ss)en|(?:viele|beste|herzliche|liebe|freundliche) gr(?:ü|ue)(?:ß|ss)e|mfg|vg|lg|gru(?:ß|ss)|danke|cordialement|bien cordialement|bien à vous|salutations(?: distinguées)?|meilleures salutations|amicalement|merci|(?:un )?(?:cordial )?saludos?(?: cordiales?)?|saludos|atentamente|muy atentamente|gracias|un abrazo)\s*[,.!]?\s*$"
MARK = r"^\s*(?:--|—|–|__|---|~{3,}|\*{3,}|={3,}|-{4,}|_{3,9})\s*$"
DEVICE = r"(?i)^\s*(?:sent (?:from|via|with) (?:my|a|the)\b.*|get (?:the|outlook)\b.{0,30}\b(?:app|for)\b.*|von unterwegs gesendet|(?:gesendet|von meinem?) .{0,12}(?:handy|smartphone|iphone|mobil).*|envoyé (?:depuis|de) mon .*|enviado desde (?:mi|un) .*)$"
LEGAL = r"(?i)^\W*(?:confidential(?:ity)?\b[^.]{0,12}(?:[:–—-]|notice|$)|confidentiel\b|confidencial(?:idad)?\b\s*(?:[:–—-]|$)|vertraulich(?:keitshinweis)?\s*(?:[:–—-]|$)|legal notice|rechtlicher hinweis|haftungsausschluss|hinweis\s*:|nota legal|aviso (?:legal|de confidencialidad)|avertissement\b|avis (?:légal|de confidentialité)|important\s*[:–—-]|notice to the reader|disclaimer\b|automatic footer|this (?:e-?mail|message|communication|transmission)(?: and (?:any files|its enclosures|any attachments))? (?:is|are|may|does|and)\b|the (?:opinions above|information in this (?:transmission|e-?mail|message)|contents of this)|contents are provided|e-?mail cannot be guaranteed|please think of the trees|think before you print|save paper|der inhalt (?:ist|dieser)|diese (?:e-?mail|nachricht) (?:enthält|ist)|e-?mails können|ce (?:message|courriel) (?:est|et ses)|le contenu de ce|el contenido de este|este (?:correo|mensaje) (?:y sus|es|puede))"
PERSON = r"(?:\p{Lu}[\p{L}\p{M}'’.-]*\p{L}\.?|\p{Lu}\.)"
PARTICLE = r"(?:v[ao]n|de[nrls]?|la|las|los|da|do|dos|di|du|le|y|zu|zum|St\.|ten|ter)"
NAME = r"^\s*" + PERSON + r"(?:[ \t]+(?:" + PARTICLE + r"[ \t]+)*" + PERSON + r"){0,3}\s*$"
CONTACT = r"(?i)^\s*(?:(?:tel|phone|telefon|téléphone|teléfono|mobil\w*|mob|móvil|fax|fon|t|m|p)\b[.:]?\s*)?(?:[+(]?\d[\d\s()./-]{6,}\d(?:\s*(?:x|ext\.?)\s*\d+)?)\s*$|^\s*(?:e-?mail:?\s*)?\S+\s*(?:@|\(at\)|\[at\])\s*\S.{0,60}$"
TITLE = r"^\s*\p{Lu}[\p{L}\p{M}'’ .-]{2,40}(?:\s[-–|]\s|,\s)\p{Lu}[\p{L}\p{M}\w&.-]*(?:[ -]\p{Lu}[\p{L}\w]*)?\s*$"


def _re(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def mails(df: DataFrame) -> DataFrame:
    """(artifact_id, text) of the e-mails among search_context_document, each once."""
    m = df.where(F.col("producer_expert") == "EmailToSearchContextExpert").where(F.length("text_content") > 0)
    return m.select(F.col("artifact_id").cast("long").alias("artifact_id"), F.col("text_content").alias("text")).dropDuplicates(["artifact_id"])


def _without_breaks(line: Column) -> Column:
    """A line without white space at its end and soft breaks of transfers (``=20``, ``=``) there."""
    x = F.rtrim(line, F.lit(" \t\r"))
    x = F.when(x.endswith("="), F.rtrim(F.left(x, F.length(x) - 1), F.lit(" \t"))).otherwise(x)
    return F.when(x.endswith("=20"), F.left(x, F.length(x) - 3)).otherwise(x)


def _hash(line: Column) -> Column:
    """Hash of a line without spaces, in lower case."""
    return F.xxhash64(F.lower(F.replace(F.replace(line, F.lit(" "), F.lit("")), F.lit("\t"), F.lit(""))))


def lines(m: DataFrame) -> DataFrame:
    """(artifact_id, line_no, line, thread, sender, who, sent) with one row for each line as it stands."""
    head = F.substring_index(F.regexp_replace(F.substring_index("text", "\n\n", 1), r"\r", ""), "\n\n", 1)
    field = lambda name: F.trim(F.regexp_extract(head, rf"(?im)^{name}[ \t]*:[ \t]*(.*)$", 1))
    m = m.select("artifact_id", "text", *(field(k).alias(k) for k in ("Subject", "From", "Date")))
    subject = F.regexp_replace(F.lower("Subject"), r"^(?:(?:re|aw|wg|fwd?|tr|rv|antwort)\s*(?:\[\d+\])?\s*:\s*)+", "")
    subject = F.regexp_replace(subject, r"\s*\(copy\)|=20|\s+", " ")
    sender = F.lower("From")
    address = F.regexp_extract(sender, r"([^\s<>\"]+@[^\s<>\"]+)", 1)
    display = F.trim(F.regexp_replace(F.regexp_replace(sender, r"<[^>]*>", ""), r"[\"=]|\S+@\S+", ""))
    display = F.when(display.contains(","), F.concat_ws(" ", F.trim(F.element_at(F.split(display, ","), -1)), F.trim(F.element_at(F.split(display, ","), 1)))).otherwise(display)
    day = F.regexp_extract("Date", r"(\d{1,2} \p{L}{3} \d{4} \d{1,2}:\d{2})", 1)
    x = m.select(
        "artifact_id",
        F.xxhash64(F.trim(subject)).alias("thread"),
        F.xxhash64(F.when(address != "", address).otherwise(sender)).alias("sender"),
        display.alias("who"),
        F.unix_timestamp(F.try_to_timestamp(day, F.lit("d MMM yyyy H:mm"))).alias("sent"),
        F.posexplode(F.split("text", "\n")).alias("p", "line"),
    )
    return x.select("artifact_id", (F.col("p") + 1).alias("line_no"), "line", "thread", "sender", "who", "sent")


def marked_lines(x: DataFrame) -> DataFrame:
    """(artifact_id, line_no, h, thread, sender, sent) of the lines with quote marks; ``h`` is the hash without them."""
    bare = _without_breaks(F.regexp_replace("line", MARKS, ""))
    return x.where(_re(F.col("line"), QUOTE) & F.col("line").rlike(r"\S")).select("artifact_id", "line_no", _hash(bare).alias("h"), "thread", "sender", "sent")


def free_lines(x: DataFrame) -> DataFrame:
    """(artifact_id, line_no, line, h, thread, sender, who, sent) of the lines without."""
    x = x.where(~_re(F.col("line"), QUOTE)).select("artifact_id", "line_no", _without_breaks(F.col("line")).alias("line"), "thread", "sender", "who", "sent")
    return x.withColumn("h", _hash(F.col("line")))


def structure(x: DataFrame) -> DataFrame:
    """Adds ``body``, ``old`` (of an older message), ``quoted`` (introduction or indented quote), ``fresh`` (none of these) and
    ``signed`` (from a closing on) to lines without a quote mark. That some with a mark stood between two of them is seen
    by their numbers."""
    line, size = F.col("line"), F.length("line")
    w = Window.partitionBy("artifact_id").orderBy("line_no")
    dated = _re(line, DATE) & _re(line, TIME)
    ends = line.endswith(":")
    x = x.select(
        "*",
        (~line.rlike(r"\S")).alias("blank"),
        (line.contains(":") & _re(line, HEADER)).alias("header"),
        ((size < 90) & _re(line, SEPARATOR)).alias("separator"),
        _re(line, r"^(?: {4}|\t)").alias("indent"),
        (ends & dated & _re(line, rf"{WROTE}.*:$|(?:wrote on|schrieb am|a écrit le|escribió el).*:$|^\s*\p{{L}}{{2,4}}\.?,? .*{TIME}.{{2,60}}:$")).alias("intro_whole"),
        ((size < 110) & dated & _re(line, rf"^\s*(?:On|Am|Le|El|\p{{L}}{{2,4}},)\s.*{DATE}") & _re(line, r"(?:,|<|schrieb|\p{L}|>)$")).alias("intro_first"),
        (ends & _re(line, WROTE + r"(?: le| on| am| el)?\s?:$|^.*<[^>]*>\s?:$")).alias("intro_last"),
    )
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.select(
        "*",
        F.min(F.when(F.col("blank"), F.col("line_no"))).over(everything).alias("head_end"),
        (F.col("line_no") - F.row_number().over(w)).alias("gone"),
        F.lead(F.struct("intro_last", "line_no"), 1).over(w).alias("after"),
        F.lag(F.struct("intro_first", "line_no"), 1).over(w).alias("before"),
        F.coalesce(F.sum(F.col("header").cast("int")).over(w.rowsBetween(1, 3)), F.lit(0)).alias("headers_ahead"),
        F.first(F.when(~F.col("blank"), F.struct("indent", "line_no")), ignorenulls=True).over(w.rowsBetween(1, 4)).alias("text_ahead"),
    )
    no = F.col("line_no")
    next_last = F.coalesce(F.col("after.intro_last") & (F.col("after.line_no") == no + 1), F.lit(False))
    prev_first = F.coalesce(F.col("before.intro_first") & (F.col("before.line_no") == no - 1), F.lit(False))
    indented_ahead = F.coalesce(F.col("text_ahead.indent") & (F.col("text_ahead.line_no") <= no + 4), F.lit(False))
    body = F.when(F.col("head_end").isNull(), ~F.col("header")).otherwise(no > F.col("head_end"))
    opens = body & ((F.col("separator") & (F.col("headers_ahead") >= 1)) | ((F.col("headers_ahead") >= 2) & (_re(line, RULE) | _re(line, SENDER))))
    intro = body & (F.col("intro_whole") | (F.col("intro_first") & next_last) | (F.col("intro_last") & prev_first))
    x = x.select("artifact_id", "line_no", "line", "h", "thread", "sender", "who", "sent", "blank", "indent", "gone", body.alias("body"), opens.alias("opens"), intro.alias("intro"), F.when(intro & ~F.col("indent"), indented_ahead).alias("style"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", F.max("opens").over(upto).alias("old"), F.coalesce(F.last("style", ignorenulls=True).over(upto), F.lit(False)).alias("indented_quotes"))
    quoted = F.col("intro") | (F.col("indented_quotes") & F.col("indent"))
    x = x.withColumn("quoted", quoted).withColumn("fresh", F.col("body") & ~F.col("blank") & ~F.col("old") & ~quoted)
    x = x.withColumn("stretch", F.col("gone") + F.sum((quoted & ~F.col("blank")).cast("int")).over(upto)).withColumn("apart", ~F.col("body") | F.col("old") | F.col("quoted"))
    one = Window.partitionBy("artifact_id", "apart", "stretch").orderBy("line_no")
    who, low = F.col("who"), F.lower(F.trim(line))
    x = x.select(
        "*",
        F.sum(F.when(F.col("fresh"), 1).otherwise(0)).over(one.rowsBetween(Window.unboundedPreceding, -1)).alias("fresh_before"),
        F.lag("blank", 1, True).over(one).alias("after_blank"),
        F.first(F.when(~F.col("blank"), F.col("line")), ignorenulls=True).over(one.rowsBetween(1, 3)).alias("next_line"),
        ((F.length(who) > 1) & (size < 60) & ((low == who) | (low == F.element_at(F.split(who, r"\s+"), 1)))).alias("named"),
    )
    following = F.col("next_line")
    short = F.length(following) < 90
    below = following.isNull() | (short & (_re(following, CONTACT) | _re(following, TITLE) | _re(following, DEVICE) | _re(following, MARK))) | _re(following, LEGAL)
    first = F.coalesce("fresh_before", F.lit(0)) == 0
    name = (size < 60) & _re(line, NAME)
    starts = F.col("fresh") & (
        ((size < 60) & (_re(line, CLOSING) | _re(line, MARK) | _re(line, DEVICE)))
        | (
            F.col("after_blank")
            & (
                ((F.col("named") | name) & (~first | (following.isNotNull() & below)))
                | (F.col("named") & below)
                | ((size < 80) & _re(line, CONTACT))
                | ((size < 60) & _re(line, TITLE))
                | _re(line, LEGAL)
            )
        )
    )
    x = x.withColumn("starts", starts)
    return x.withColumn("signed", F.max("starts").over(one.rowsBetween(Window.unboundedPreceding, 0)))


def reasons(df: DataFrame) -> DataFrame:
    """(artifact_id, line_no, why) of each line with text of the e-mails in ``df`` (search_context_document): ``header``,
    ``thread`` (retold), ``sender`` (recurrent closing), ``mark``, ``older`` (message or introduction), ``closing``, ``new``."""
    every = lines(mails(df))
    x = structure(free_lines(every)).where(~F.col("blank"))
    rule = F.when(~F.col("body"), "header").when(F.col("apart"), "older").when(F.col("signed"), "closing").otherwise("new")
    last = Window.partitionBy("artifact_id", "apart", "stretch").orderBy(F.desc("line_no"))
    tail = (rule == "new") & (F.length("line") < 60) & ~_re(F.col("line"), r"[.!?,:;)–-]\s*$")
    place = F.sum(F.when(rule == "new", 1).otherwise(0)).over(last)
    free = x.select("artifact_id", "line_no", "h", "thread", "sender", "sent", rule.alias("rule"), (F.length("line") >= FREE).alias("long"), (tail & (place <= 3)).alias("tail"))
    marked = marked_lines(every).select("*", F.lit("mark").alias("rule"), F.lit(True).alias("long"), F.lit(False).alias("tail"))
    x = materialise(free.unionByName(marked), "lines")
    body = x.where(F.col("rule") != "header")
    # Thread window: the first mail of each line of a thread. Rank 1 is a least value, so a hot line is aggregated where it lies.
    rank = F.struct(F.coalesce("sent", F.lit(1 << 62)).alias("sent"), "artifact_id", "sender")
    authored = body.groupBy("thread", "h").agg(F.min(rank).alias("first"), F.max("artifact_id").alias("b"), F.min("artifact_id").alias("a"))
    authored = authored.where(F.col("a") != F.col("b")).select("thread", "h", F.col("first.sent").alias("first_sent"), F.col("first.artifact_id").alias("first_id"), F.col("first.sender").alias("first_sender"))
    # Sender window: closing lines by the threads that the sender has them in.
    ending = body.where((F.col("rule") == "closing") | F.col("tail"))
    recurrent = ending.groupBy("sender", "h", "thread").agg(F.lit(1).alias("one")).groupBy("sender", "h").agg(F.count("one").alias("threads")).where(F.col("threads") >= THREADS)
    y = x.join(authored, ["thread", "h"], "left").join(recurrent, ["sender", "h"], "left")
    other = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("artifact_id"))
    told = F.when(F.col("rule").isin("mark", "older"), other).when(F.col("rule") == "new", other & F.col("long") & (F.col("sender") != F.col("first_sender")) & (F.col("sent") > F.col("first_sent"))).otherwise(False)
    again = F.when(F.col("rule") == "closing", F.col("threads").isNotNull()).when(F.col("tail"), F.col("threads") >= 3).otherwise(False)
    why = F.when(F.coalesce(told, F.lit(False)), "thread").when(F.coalesce(again, F.lit(False)), "sender").otherwise(F.col("rule"))
    return y.select("artifact_id", F.col("line_no").cast("int").alias("line_no"), why.alias("why"))


def newly_written(df: DataFrame) -> DataFrame:
    """(artifact_id, line_no) of each newly written line of the e-mails in ``df``."""
    return reasons(df).where(F.col("why") == "new").select("artifact_id", "line_no")


def steps(df: DataFrame) -> DataFrame:
    """(why, n_lines): how many lines each step of the method leaves out, or keeps (``new``)."""
    return reasons(df).groupBy("why").agg(F.count(F.lit(1)).alias("n_lines"))


def new_texts(df: DataFrame) -> DataFrame:
    """(artifact_id, new_text): the newly written lines of each e-mail; an empty text where nothing is left."""
    m = mails(df)
    kept = newly_written(df).join(lines(m).select("artifact_id", "line_no", _without_breaks(F.col("line")).alias("line")), ["artifact_id", "line_no"])
    g = kept.groupBy("artifact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("new_text"))
    return m.select("artifact_id").join(g, "artifact_id", "left").select("artifact_id", F.coalesce("new_text", F.lit("")).alias("new_text"))
