"""Half-planes of the confusion and cloud tests of the water rules, as (rule, y, x, polygons of (comparison, a, b)): ``y < a x + b``."""

from __future__ import annotations

# fmt: off
# Fixed values, in the order of publication.
USED = (
    ("confusion1a", "hue", "ndvi", (
        (("<", -49.74358974358937, 196.13881379789424), (">", -388.2352941176396, 71.02910650151634), (">", -23.22580645161292, 203.03136575198846)),
        (("<", -77.40259740259752, 188.94963266652547), ("<", -23.22580645161292, 203.03136575198846), (">", -51.16071428571436, 192.92896822354658)),
        ((">", -66.84871654833425, 187.2555492802913), ("<", -110.14373716632423, 183.9847457695416), ("<", -51.16071428571436, 192.92896822354658)),
        (("<", -66.84871654833425, 187.2555492802913), (">", -90.93264248704664, 178.5458232513616), ("<", -181.85567010309282, 178.56713333595917)),
        ((">", -181.85567010309282, 178.56713333595917), ("<", -5040.000000000369, 179.70576091328076), ("<", -151.6182572614111, 180.85147538423308)),
    )),
    ("confusion1b", "sat", "blue", (
        (("<", -7.661776708707255, 2.2305740929954756), ("<", 0.0, 1.1986832555860636), (">", -1.261626977704373, 1.2006455384115522)),
        (("<", -1.261626977704373, 1.2006455384115524), (">", -185.04244838331917, 1.4864906858850455), (">", 3.157630522088353, 0.48948725612204136)),
        ((">", 1.9125690254685646, 0.4960830587891577), ("<", -0.19140526983264608, 1.0284227087903544), ("<", 3.157630522088353, 0.48948725612204136)),
        (("<", -1.2188600719125362, 1.2883854521341145), ("<", -0.04742916852574311, 1.005253704291078), (">", -0.19140526983264608, 1.0284227087903544)),
        (("<", 1.9125690254685646, 0.49608305878915765), (">", -0.34084769909052515, 0.5080206956708082), (">", 12.772331898427453, -2.2516132318916604)),
    )),
    ("confusion2a", "hue", "ndvi", (
        (("<", -323.2653061224475, 183.40185793495874), ("<", 158.07495741056292, 215.95099454586804), (">", -19.45161290322491, 195.80505541813127)),
        (("<", -19.45161290322491, 195.80505541813127), (">", -114.87179487179472, 184.97665280719505), (">", 38.393782383421026, 198.16659433900784)),
        (("<", -360.00000000000256, 181.9021636393549), ("<", 38.393782383421026, 198.16659433900784), (">", -43.145604395603854, 191.14936474697558)),
        (("<", -43.145604395603854, 191.14936474697558), (">", -158.76923076923046, 181.19886641019133), (">", 429.86013986014024, 204.95374714744474)),
        (("<", -398.29787234042374, 180.784463735428), ("<", 429.86013986014024, 204.95374714744474), (">", 18.69718309859311, 188.36074739446966)),
        (("<", -2132.068965517284, 149.28399045541414), ("<", 18.69718309859311, 188.36074739446966), (">", -180.57507987220498, 180.31886386417185)),
        (("<", -401.15384615384954, 180.73257422870344), (">", -2132.068965517284, 149.28399045541414), (">", -156.29268292682937, 180.705030134435)),
        (("<", -4859.999999999733, 181.23414367798406), ("<", -156.29268292682937, 180.705030134435), (">", -201.73913043478356, 179.98228908171535)),
    )),
    ("confusion2b", "swir2", "blue", (
        (("<", -0.323042168674698, 0.06801551910768028), ("<", 0.5604681404421293, -0.026340620936280618), (">", 0.0009537434430138915, -0.00020080770147852338)),
        (("<", -0.49875724937862376, 0.10501178024026461), ("<", 1.4297520661157026, -0.11917742768595024), (">", -0.323042168674698, 0.06801551910768028)),
        (("<", -0.7169373549883978, 0.1509489196635725), ("<", 1.3166023166023175, -0.10602376930501928), (">", -0.49875724937862376, 0.10501178024026461)),
        ((">", 8.135802469135795, -1.7129677854938241), ("<", -0.09797151488994237, 0.07273194729175612), (">", -0.7169373549883978, 0.1509489196635725)),
        (("<", -0.3973412112259951, 0.1376577501846375), ("<", 2.0279720279720297, -0.19591755900349633), (">", -0.09797151488994237, 0.07273194729175612)),
        (("<", -0.9340727048675277, 0.2540613928681448), ("<", 1.7377450980392386, -0.15600001914828718), (">", -0.3973412112259951, 0.1376577501846375)),
        (("<", 0.5585585585585591, 0.024977477477477597), (">", -0.9340727048675277, 0.2540613928681448), (">", 16.392156862745423, -3.503564644607911)),
        ((">", 2.1705685618729085, -0.4192576818561867), ("<", 0.08437200383509218, 0.1306506921140938), ("<", 16.392156862745423, -3.503564644607911)),
        ((">", 0.5275310834813499, -0.06292392873001777), ("<", -1.3333333333333348, 0.5043489583333338), ("<", 2.1705685618729085, -0.4192576818561867)),
    )),
    ("confusion2c", "val2", "swir2", (
        (("<", -3.0133928571428577, 0.7676348612804655), ("<", -0.2571428571428576, 0.4733992419470712), (">", -1.3327526132404202, 0.47057808119912775)),
        ((">", 1.0686619718309858, 0.04612288510953274), ("<", -1.3327526132404202, 0.4705780811991277), (">", -228.66666666671583, -0.12568418898601724)),
    )),
    ("confusion3a", "sat", "val", (
        (("<", -2.2326203208556143, 1.5257678652540891), ("<", -0.00534759358288754, 0.9973687549803982), (">", -0.7477718360071299, 0.9999601250716116)),
        ((">", 0.7335092348284965, 0.4754156611894009), ("<", -0.7397078353253644, 1.1715886848550134), (">", -2.2326203208556143, 1.5257678652540891)),
        (("<", -16.484848484848392, 8.612000825120266), ("<", -0.018055555555555623, 1.0003835971762043), (">", -0.7397078353253644, 1.1715886848550134)),
        ((">", 1.545243619489559, 0.18796800118751184), ("<", -0.7477718360071299, 0.9999601250716116), (">", -2.178002894356006, 1.004952227667868)),
        ((">", 0.4907407407407418, 0.41935537119167954), ("<", -2.178002894356006, 1.0049522276678682), (">", -42.39534883720828, 1.1453275299128312)),
        ((">", 1.8633540372670816, 0.11816569488389755), ("<", 0.4907407407407418, 0.41935537119167954), (">", 0.03696098562628343, 0.4270369171578985)),
    )),
    ("confusion3b", "val2", "swir2", (
        (("<", -8.999999999999996, 1.1836428258302192), ("<", -0.25605798072220454, 0.4734020874128705), (">", -1.567464014026764, 0.46996246890364646)),
        (("<", -1.567464014026764, 0.46996246890364646), (">", -2.378156296376779, 0.46783614638503673), (">", 42.666666666666465, -3.77744786750256)),
        ((">", 2.0883643769837543, 0.046885467371981064), ("<", -2.378156296376779, 0.4678361463850367), (">", -228.66666666671583, -0.12568418898601724)),
        (("<", -4.78571428571428, 0.6947383023337331), ("<", 2.0883643769837543, 0.04688546737198104), (">", 1.0673991822800284, 0.04612194073506829)),
    )),
    ("confusion4a", "hue", "val", (
        (("<", -171.9402985074626, 284.156529850746), ("<", 26.190476190476137, 177.22782738095222), (">", -15.423197492163006, 180.02374608150456)),
        (("<", -15.423197492163006, 180.02374608150456), (">", -787.6056338028174, 231.90475352112665), (">", 205.6451612903227, 32.944203629032074)),
        (("<", 205.6451612903227, 32.944203629032074), (">", -13.36870026525184, 76.81541777188309), (">", 430.62670299727523, -116.73882833787471)),
    )),
    ("confusion4b", "ndvi", "val", (
        (("<", -0.4006259780907667, 0.25238142590835944), ("<", 2.6183213726200956, -0.14069421605734192), (">", 0.04660702286934955, -0.016930462975588336)),
        (("<", -5.639344262295089, 3.4069990713440506), ("<", 0.04660702286934955, -0.01693046297558834), (">", -0.1755502266736536, -0.0062391453413314)),
    )),
    ("clouds", "hue", "blue", (
        (("<", 0.41364045204877986, 241.58503770843737), (">", -11159.99999999992, 706.602272727269), (">", 6.608688285703755, 192.68448650503294)),
        (("<", 6.608688285703755, 192.68448650503294), (">", -1185.0000000000016, 247.52556818181824), (">", 10.590659688301406, 161.25283307931002)),
        (("<", -2880.000000000025, 22978.102736040695), ("<", 10.590659688301406, 161.25283307931002), (">", -8.242805824080952, 162.61183882935126)),
        ((">", -2.390925916467925, 116.11991638044418), ("<", -8.242805824080952, 162.61183882935126), (">", -474.7757035969288, 196.2764286118238)),
        ((">", -1.6963273991013927, 110.6014811233367), ("<", -2.390925916467925, 116.11991638044418), (">", -22.581644771334126, 119.5459742877233)),
        (("<", -22.581644771334126, 119.5459742877233), (">", -52.75862068965494, 124.66654813682212), (">", 5.205078970337692, 107.64583620801584)),
        (("<", -52.75862068965494, 124.66654813682212), (">", -118.032786885246, 135.7425813797672), (">", 19.636363636364297, 103.40817124694752)),
    )),
)
#: Mainly snow and ice; no part of the mask.
OPTIONAL = (
    ("confusion5a", "hue", "ndvi", (
        (("<", -41.390273937152394, 199.35367359600045), ("<", 980.036035727654, 640.801356804259), (">", 321.2575972304732, 340.18915447676704)),
        (("<", -65.8789625360229, 189.84341168861118), ("<", 321.2575972304732, 340.18915447676704), (">", 79.91668325971264, 230.0610455089285)),
        (("<", -79.35871743486943, 186.12503008982895), ("<", 79.91668325971264, 230.0610455089285), (">", 15.881427495031524, 200.84063066666678)),
        (("<", -100.08620689655164, 182.9224157290126), ("<", 15.881427495031524, 200.84063066666678), (">", -7.254757545361759, 190.28318201319394)),
        (("<", -124.615384615385, 180.97745477457968), ("<", -7.254757545361759, 190.28318201319394), (">", -19.055497384172963, 184.89829661814167)),
        ((">", -25.873050054257675, 181.7873272802364), ("<", -140.7166123778528, 180.37940215061724), ("<", -19.055497384172963, 184.89829661814167)),
        ((">", -30.31391870513669, 179.76088071280893), ("<", -187.17066924733743, 179.80989844735336), ("<", -25.873050054257675, 181.7873272802364)),
        (("<", -155.73667711598745, 180.19526360453366), (">", -187.17066924733743, 179.80989844735336), (">", 953.6618512259481, 179.45338828470543)),
        ((">", 47.569422700668035, 179.7365421686196), ("<", 31.592769201982623, 180.0699929381771), ("<", 953.6618512259481, 179.45338828470543)),
        ((">", 31.592769201982623, 180.0699929381771), ("<", -102.42677824267734, 182.86713197826745), ("<", 3158.312807223996, 177.97909740428108)),
        ((">", -113.32329793300876, 179.78682114381763), ("<", -318.39195979899586, 187.37456878244578), ("<", 47.569422700668035, 179.7365421686196)),
        (("<", -113.32329793300876, 179.78682114381763), (">", -142.88372093023278, 179.79605877600426), ("<", -159.8049491628185, 181.50668919264223)),
        ((">", 1080.0000000000098, 56.170157613212425), ("<", -120.30147453115049, 180.0450207269362), (">", -159.8049491628185, 181.50668919264223)),
        (("<", -30.31391870513669, 179.76088071280893), (">", -55.18624641833813, 168.4111995849124), (">", 2769.534803268574, 178.88592798719202)),
    )),
    ("confusion5b", "tirs1", "swir1", (
        (("<", -37.4607329842932, 270.5710658903785), ("<", 3873.750000000057, 289.8215562167857), (">", 42.76923076923073, 213.50123620476631)),
        (("<", -1.6063348416289716, 270.74753675623697), (">", -37.4607329842932, 270.5710658903785), (">", 226.66666666666728, 82.6898179355349)),
        (("<", -1.7241379310344813, 270.8445862545011), ("<", 5.714285714284849, 270.7835679355356), (">", -1.6063348416289716, 270.74753675623697)),
        (("<", -15.871404399323138, 282.49950226294675), ("<", 28.243727598566267, 270.5987561075786), (">", -1.7241379310344813, 270.8445862545011)),
        (("<", -14.764776839565704, 282.2009721876465), ("<", 4484.999999999887, 234.03942731053635), (">", 28.243727598566267, 270.5987561075786)),
    )),
    ("confusion5c", "blue", "sat", (
        ((">", 4.8417656150246735, -2.1345948555473897), ("<", 0.1372549019607847, 2.541367543066504), ("<", 65.27916047754636, -44.97113295340387)),
        ((">", 8.084344025406292, -5.357496374168239), ("<", 4.8417656150246735, -2.1345948555473897), (">", -2.0288015770823886, 2.7350940836938467)),
        (("<", -109.79419385952704, 111.80572088090663), ("<", 8.084344025406292, -5.357496374168237), (">", -4.3978728050230655, 4.630836908607832)),
        (("<", -4.3978728050230655, 4.630836908607832), (">", -6.7287331975861875, 6.496003229047556), (">", -1.662267492121429, 1.8490682560509786)),
        ((">", -2.290356886887485, 2.425148455618598), ("<", -6.7287331975861875, 6.496003229047557), (">", -499.2108270862114, 400.5826752028271)),
        (("<", -2.290356886887485, 2.425148455618598), (">", -2.6721311475409864, 2.7310450819672165), (">", -1.557000478788249, 1.7525179201366887)),
        (("<", -1.662267492121429, 1.8490682560509786), (">", -4.648304510366765, 4.58784527684082), (">", 0.22760258599122304, -0.07269337962982575)),
    )),
)
