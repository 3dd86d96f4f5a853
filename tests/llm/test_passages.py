"""Quoted passages are linked as wholes before their lines are."""

from netlytics.llm import quotes


def test_passages_before_lines(spark):
    rows = [
        (1, 0, "I agree.\nThe red car is fast.\nBye"),
        (1, 1, "No."),
        (1, 3, "I agree.\nTo what?"),
        (1, 4, "> I agree.\n>\n> the red CAR is fast.\nQuite."),  # only turn 0 has both lines in this order
        (1, 5, "> The red car is fast.\n> I agree.\nturned round"),  # no message has this passage: a vote for each line, the latest of equals
        (1, 6, ">> I agree.\n>> The red car is fast.\n> Quite.\nso"),
        (1, 7, "> I agree.\nonly that"),
        (2, 0, "I agree.\n> x\nThe red car is fast."),  # a quotation parts the run
        (2, 1, "I agree."),
        (2, 2, "> I agree.\n> The red car is fast.\nelsewhere"),
    ]
    df = spark.createDataFrame([(*r[:2], "user", r[2]) for r in rows], "conv_id long, turn long, role string, text string")
    messages = quotes.link_quotations(df)
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_quoted, r.n_linked) for r in messages.collect()}
    assert got[1, 4] == (0, 2, 2)
    assert got[1, 5] == (3, 2, 2)
    assert got[1, 6] == (4, 3, 3)
    assert got[1, 7] == (3, 1, 1)
    assert got[2, 2] == (1, 2, 2)
    order = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.place) for r in quotes.reply_order(messages).collect()}
    assert order[1, 4] == (0, 0, 3) and order[1, 7] == (3, 0, 6) and len(order) == len(rows)
