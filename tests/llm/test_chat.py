import hashlib

from pairlight.llm import chat


def test_escapes_are_reversible_and_hide_control_strings():
    for text in ("", "\\", "\\:", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>>", "<|user|>\n</s>\n", "<<s>", "\\</s>\\", "a\\:b<|", "[[INST]"):
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL)


def test_spans_of_an_appending_template():
    turns = [("user", "hi"), ("assistant", "</s> é"), ("user", ""), ("assistant", "hi")]
    r = chat.render_incrementally(chat.marked, turns)
    assert r.rewritten_at is None and chat.read_back(r.formatted) == turns
    assert r.spans[0][0] == 3 and all(a[1] == b[0] for a, b in zip(r.spans, r.spans[1:])) and r.spans[-1][1] == len(r.formatted)
    assert [chat.unescape(t) for t in chat.loss_text(r, turns)] == ["</s> é", "hi"]


def test_black_box_templates():
    inst = lambda turns: "".join(f"[{r}] {t} [/{r}]" for r, t in turns)
    turns = [("user", "a"), ("assistant", "bb"), ("user", "bb")]
    r = chat.render_incrementally(inst, turns)
    assert [r.formatted[a:b] for a, b in r.texts] == ["a", "bb", "bb"] and r.rewritten_at is None

    def forgets(turns):  # drops what earlier assistants said
        return "".join(f"{r}:{t if r != 'assistant' or k == len(turns) - 1 else ''};" for k, (r, t) in enumerate(turns))

    assert chat.render_incrementally(forgets, turns).rewritten_at == 2

    def closing(turns):  # a mark at the end that the next turn removes
        return "|".join(t for _, t in turns) + "<end>"

    assert chat.render_incrementally(closing, turns).rewritten_at == 0


def test_shared_start():
    assert [chat.shared_start(a, b) for a, b in (("", ""), ("a", ""), ("ab", "ac"), ("ab", "ab"), ("ab", "abc"), ("xb", "yb"))] == [0, 0, 1, 2, 2, 0]


def test_rows(spark):
    rows = [
        (1, 1, "assistant", "two", "x"), (1, 0, "user", None, "x"), (1, 1, "assistant", "two", "x"), (None, 0, None, "lost", "x"), (2, None, "user", "</s>", "x"),
        (3, 0, "system", "s" * 100_000, "x"), (3, 1, "assistant", "", "x"),
    ]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest_chats(chats).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (3, 6, sha("twotwo"))
    assert got[1].turns_sha256 == sha("user\n\nassistant\ntwo\nassistant\ntwo\n")
    assert got[None].turns_sha256 == sha("\nlost\n") and got[2].turns_sha256 == sha("user\n</s>\n") and got[3].loss_chars == 0
    assert chat.digest_chats(chats.limit(0)).count() == 0
    spans = {r.conv_id: r for r in chat.format_chats(chats).collect()}
    assert spans[1].roles == ["user", "assistant", "assistant"] and not spans[1].rewrites


def test_many_turns_and_many_conversations(spark):
    long = [(0, k, "assistant" if k % 2 else "user", f"turn {k}", "") for k in range(1200)]
    many = [(c, 0, "assistant", f"</s> {c}", "") for c in range(1, 700)]
    huge = [(-5, k, "assistant", chr(97 + k) * 3_000_000, "") for k in range(2)]  # beyond what is remembered and what a batch holds
    rows = {r.conv_id: r for r in chat.digest_chats(spark.createDataFrame(long + many + huge, "conv_id long, turn long, role string, text string, x string")).collect()}
    assert len(rows) == 701 and rows[0].n_turns == 1200 and rows[-5].loss_chars == 6_000_000
    said = "".join(t for _, _, role, t, _ in long if role == "assistant")
    assert rows[0].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert all(rows[c].loss_chars == len(f"</s> {c}") for c in range(1, 700))


def test_query_has_the_control_conversation(spark, sf_dir):
    rows = {r.conv_id: r for r in chat.op4_incremental_rendering(spark, sf_dir).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-1].loss_chars == len(said) and rows[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def decoded(formatted):
    """Roles and texts of an output, character by character, without the module's own patterns."""
    assert formatted[:3] == "<s>"
    at, turns = 3, []

    def until(end):
        nonlocal at
        out = []
        while formatted[at : at + len(end)] != end:
            if formatted[at] == "\\":
                assert formatted[at + 1] in "\\:"
                out.append("\\" if formatted[at + 1] == "\\" else "")
                at += 2
            else:
                out.append(formatted[at])
                at += 1
        at += len(end)
        return "".join(out)

    while at < len(formatted):
        assert formatted[at : at + 2] == "<|"
        at += 2
        turns.append((until("|>\n"), until("</s>\n")))
    return turns


def test_query_equals_an_independent_reading(spark, sf_dir):
    """The whole result, from the table's own rows and from the outputs read by another decoder."""
    rows = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        rows.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    said = "</s>[INST] ok [/INST]"
    rows[-1] = [(0, "user", said), (1, "assistant", said)]
    table = spark.createDataFrame([(i, *t) for i, turns in rows.items() for t in turns], "conv_id long, turn long, role string, text string")
    formatted = {r.conv_id: r for r in chat.format_chats(table).collect()}
    got = {r.conv_id: r for r in chat.op4_incremental_rendering(spark, sf_dir).collect()}
    assert set(got) == set(rows) == set(formatted)
    for i, turns in rows.items():
        turns = [t[1:] for t in sorted(turns)]
        assert decoded(formatted[i].formatted) == turns
        loss = "".join(t for role, t in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted[i].formatted))
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256, got[i].formatted_chars) == want
